"""Fixed values of the text rules: word lists, site lists, labels.

Keywords are matched as substrings, so an entry that contains another entry of its list is left out.
"""

MENTEE_INTENTS = [
    "greeting", "find_mentor", "ask_mentor_recommendation", "ask_program_recommendation",
    "recommendation_explanation", "task_help", "submit_task", "roadmap_request", "materials_request", "faq",
    "complaint", "support_request", "general_question", "off_topic", "mentor_analytics", "mentor_workflow_help"]
INTENT_ALIASES = {"explanation_request": "general_question"}

ABUSE = [
    "fuck", "shit", "bitch", "asshole", "bastard", "dick", "pussy", "stfu", "wtf", "idiot", "stupid bot",
    "useless", "dumb", "trash", "garbage", "suck",
    "يلعن", "كسم", "متناك", "عرص", "شرموط", "يا حمار", "يا غبي", "كلب", "حيوان", "ولاد الوسخة", "احا",
    "اخرس", "يا واطي", "يا قذر", "زبالة", "تافه", "يا عبيط"]

GREETINGS = [
    "hi", "hello", "hey", "yo", "sup", "اهلا", "اهلاً", "سلام", "مرحبا", "مرحباً", "السلام عليكم",
    "صباح الخير", "صباح النور", "مساء الخير", "تصبح على خير", "كيفك", "كيف حالك", "كيف أخبارك", "ازيك",
    "أنت كويس"]

MENTEE_RULES = [
    ("complaint", [
        "شكوى", "اشتك", "بشتكي", "أشتكي", "بلاغ", "أبلغ عن", "ابلغ عن", "سوء سلوك", "مش محترم",
        "غير محترم", "قلة احترام", "شتم", "تحرش", "إساءة", "اساءة", "المرشد وحش", "المرشد سيء",
        "مينتوري وحش", "complain", "report abuse", "rude", "abusive", "harassment", "misconduct",
        "disrespectful"]),
    ("support_request", [
        "مش شغال", "مش بيشتغل", "مش بيرفع", "مش عارف أرفع", "مش بيفتح", "الصفحة مش", "مش بتفتح",
        "فيه مشكلة", "فيه خطأ", "فيه بق", "مش بيحمل", "مش بيظهر", "not working", "doesn't work",
        "can't upload", "cannot upload", "error", "bug", "broken", "crashed", "can't login", "cannot login",
        "page not loading"]),
    ("submit_task", [
        "سلم", "تسليم", "ارفع الشغل", "ديدلاين", "الموعد النهائي", "فين أرفع", "امتى الموعد", "submit",
        "submission", "turn in", "hand in", "deadline"]),
    ("task_help", [
        "ما فاهمتش", "تاسك", "واجب", "assignment", "شرحلي الكود", "الكود ده", "الكود مش شغال", "الفنكشن",
        "مش عارف أحل", "مش عارف احل", "ساعدني في الكود", "أنا تعبت", "انا تعبت", "مش قادر أكمل",
        "مش قادر اكمل", "خلاص مش قادر", "أنا ضايع", "انا ضايع", "أنا تايه", "انا تايه", "مش فاهم حاجة",
        "مش فاهم اي حاجة", "يائس", "محبط", "تعبت من الكود", "صعب أوي", "صعبة أوي", "مش عارف أعمل ايه",
        "help with task", "task is hard", "don't understand the task", "can't solve",
        "help me with this code", "explain this function", "i'm frustrated", "i'm stuck", "i'm lost",
        "i can't do this", "i give up", "this is too hard", "debugging help", "my code",
        "code keeps crashing", "code not working"]),
    ("materials_request", [
        "فيديو", "فديو", "مقال", "كورس", "دورة", "دورات", "موارد", "مواد تعليمية", "مادة تعليمية", "video",
        "article", "course", "tutorial", "resource", "material"]),
    ("recommendation_explanation", [
        "ليه رشحت", "ليه اخترت", "ليه ده أحسن", "ليه ده احسن", "ليه ده الأفضل", "إيه اللي خلاه مناسب",
        "ايه اللي خلاه مناسب", "ليه المنتور ده", "ليه المرشد ده", "سبب الترشيح", "أسباب الترشيح",
        "ليه ده مش", "why did you recommend", "why this mentor", "why is this the best",
        "why was this recommended", "explain the recommendation", "why not the other",
        "what made this mentor", "why is he recommended", "why is she recommended", "why choose this"]),
    ("general_question", [
        "ايه ", "يعني ايه", "معنى", "شرحلي", "شرح لي", "إشرح", "الفرق بين", "ليه بنستخدم", "ليه ال",
        "what is", "what are", "what does", "explain", "definition of", "meaning of", "difference between",
        "why do we use", "how does", "what's the difference"]),
    ("roadmap_request", [
        "roadmap", "خريطة", "خطة تعلم", "مسار", "learning path", "study plan", "أبدأ أتعلم", "أبدأ اتعلم",
        "كيف أبدأ", "ازاي أبدأ", "إزاي أبدأ", "كيف أتعلم", "ازاي أتعلم", "خطة الدراسة", "ترتيب الدراسة",
        "study path", "how to learn", "how to start learning", "path to learn", "guide to learn",
        "steps to learn"]),
    ("ask_program_recommendation", [
        "رشحلي برامج", "رشحلي برنامج", "برامج مناسبة", "برنامج إرشاد", "برنامج ارشاد", "اقترح برامج",
        "برامج ليا", "recommend program", "suggest program", "program for me", "programs for me",
        "mentorship program", "find program"]),
    ("ask_mentor_recommendation", [
        "رشح", "اقترح", "توصية", "مناسب", "توصيات", "اقتراحات", "recommend me", "recommend a mentor",
        "suggest mentors", "suggest a mentor", "best mentor for me"]),
    ("faq", [
        "become a mentor", "become mentor", "be a mentor", "join as mentor", "register as mentor",
        "sign up as mentor", "want to mentor", "ابقى مرشد", "أبقى مرشد", "ابقى mentor", "أبقى mentor",
        "اكون مرشد", "أكون مرشد", "اكون mentor", "أكون mentor", "اسجل كمرشد", "أسجل كمرشد",
        "اسجل ك mentor", "كيف اصير مرشد", "كيف أصبح مرشد"]),
    ("find_mentor", [
        "عايز مرشد", "ابغى مرشد", "ابغى حد", "عايز حد", "دور على", "ابحث", "احسن", "افضل", "مين أحسن",
        "كام مرشد", "عدد المرشدين", "عايز mentor", "ممكن mentor", "need a mentor", "find mentor",
        "search mentor", "best mentor", "top mentor", "mentor in", "mentor for", "looking for"]),
    ("off_topic", [
        "الجو", "weather", "مين رئيس", "president", "joke", "سياسة", "politics", "رياضة", "sports",
        "football", "match", "أغنية", "song", "music", "movies", "film", "شعر", "poem", "poetry", "قصيدة",
        "اخبار", "news", "ترفيه", "entertainment"]),
    ("faq", [
        "مدة البرنامج", "كم مدة", "كام ساعة", "تسجيل", "اسجل", "أسجل", "سعر", "مجاني", "مجانا", "إلغاء",
        "الغي", "الغاء", "تقييم", "أعطي رأي", "اعطي رأي", "متابعة", "حفظ برنامج", "حالات الطلب",
        "حالة الطلب", "هل يمكن", "هل ممكن", "القواعد", "الشروط", "المنصة", "اتواصل", "الدعم", "التواصل",
        "register", "sign up", "login", "create account", "free", "price", "cost", "cancel", "feedback",
        "rate", "review process", "how it works", "platform rules", "application status", "duration",
        "how long", "contact support", "reach support", "support team"]),
]

MENTOR_RULES = [
    ("off_topic", ["fuck", "shit", "bitch", "joke", "weather", "news", "يلعن", "يا حمار", "كلب", "نكتة", "الجو"]),
    ("materials_request", [
        "exercise", "تمرين", "interview", "مقابلة", "quiz", "امتحان", "question", "أسئلة", "assignment", "واجب",
        "project", "مشروع", "idea", "فكرة"]),
    ("mentor_analytics", [
        "how many", "كام", "statistic", "إحصاء", "analytics", "تحليل", "performance", "أداء", "engagement", "top",
        "أفضل"]),
    ("mentor_workflow_help", [
        "contact", "تواصل", "feedback", "تقييم", "session", "جلسة", "review", "مراجعة", "application", "تقديم",
        "mentee", "منتي", "manage", "إدارة"]),
    ("faq", ["how", "إزاي", "كيف", "create", "أنشئ", "feature", "ميزة", "rule", "قاعدة", "cost", "رسوم"]),
    ("greeting", ["hello", "hi", "hey", "مرحبا", "ازيك", "السلام", "صباح", "مساء"]),
]

POSITIVE_WORDS = [
    "good", "great", "excellent", "love", "happy", "amazing", "ممتاز", "جيد", "رائع", "شكرا", "thanks",
    "helpful", "supportive", "مفيد", "منظم", "واضح", "مخلص"]
NEGATIVE_WORDS = [
    "bad", "terrible", "hate", "sad", "poor", "disappointed", "سيئ", "ضعيف", "أسوأ", "غير منظم",
    "not helpful", "waste of time"]

LINK_KINDS = {
    "videos": ["youtube", "youtu.be", "vimeo", "udemy", "lynda"],
    "courses": ["coursera", "edx", "pluralsight", "skillshare", "treehouse"],
    "project words": ["project", "repo", "example", "template", "starter"],
    "docs": ["docs", "documentation", "developer.mozilla", "learn.microsoft", "official"],
    "course sites": ["freecodecamp", "codecademy", "w3schools", "tutorialspoint"],
}
MATERIAL_KINDS = [
    ("videos", ["youtube", "youtu.be", "vimeo", "udemy"]),
    ("courses", ["coursera", "edx", "pluralsight"]),
    ("projects", ["github"]),
    ("docs", ["docs", "documentation"]),
]

INTENT_SITES = {
    "roadmap": ["roadmap.sh", "github.com", "medium.com", "coursera.org", "freecodecamp.org"],
    "course": ["coursera.org", "udemy.com", "youtube.com", "edx.org", "pluralsight.com", "linkedin.com/learning"],
    "materials": ["freecodecamp.org", "medium.com", "dev.to", "github.com", "geeksforgeeks.org", "w3schools.com"],
    "docs": ["developer.mozilla.org", "learn.microsoft.com", "docs.python.org", "react.dev", "devdocs.io"],
    "projects": ["github.com", "dev.to", "freecodecamp.org", "kaggle.com"],
    "general_search": ["stackoverflow.com", "github.com", "medium.com", "dev.to", "freecodecamp.org"],
}
TOPIC_SITES = {
    "ai": ["kaggle.com", "huggingface.co", "tensorflow.org", "pytorch.org"],
    "machine learning": ["kaggle.com", "scikit-learn.org", "tensorflow.org"],
    "deep learning": ["pytorch.org", "tensorflow.org", "huggingface.co"],
    "data science": ["kaggle.com", "towardsdatascience.com", "datacamp.com"],
    "nlp": ["huggingface.co", "spacy.io"],
    "web": ["developer.mozilla.org", "web.dev", "css-tricks.com"],
    "react": ["react.dev", "nextjs.org"],
    "angular": ["angular.io", "angular.dev"],
    "vue": ["vuejs.org"],
    "python": ["docs.python.org", "realpython.com"],
    "javascript": ["developer.mozilla.org", "javascript.info"],
    "typescript": ["typescriptlang.org"],
    "java": ["docs.oracle.com", "baeldung.com"],
    "csharp": ["learn.microsoft.com", "dotnet.microsoft.com"],
    "dotnet": ["learn.microsoft.com", "dotnet.microsoft.com"],
    ".net": ["learn.microsoft.com", "dotnet.microsoft.com"],
    "mobile": ["developer.android.com", "flutter.dev", "reactnative.dev"],
    "flutter": ["flutter.dev", "pub.dev"],
    "android": ["developer.android.com"],
    "ios": ["developer.apple.com"],
    "devops": ["docker.com", "kubernetes.io"],
    "cloud": ["aws.amazon.com", "cloud.google.com", "learn.microsoft.com"],
    "cybersecurity": ["owasp.org", "cybrary.it"],
    "design": ["figma.com", "dribbble.com", "behance.net"],
    "ui": ["figma.com", "dribbble.com", "material.io"],
    "ux": ["figma.com", "nngroup.com", "interaction-design.org"],
    "database": ["postgresql.org", "mysql.com", "use-the-index-luke.com"],
    "sql": ["learn.microsoft.com", "postgresql.org", "sqlzoo.net"],
    "backend": ["github.com", "medium.com", "roadmap.sh"],
    "frontend": ["developer.mozilla.org", "css-tricks.com", "web.dev"],
}
ARABIC_SITES = ["maharatech.gov.eg", "youtube.com", "harmash.com", "academy.hsoub.com"]

PERSONAL_TOPICS = [
    ("profile", ["my profile", "ملفي", "my status", "my info"]),
    ("mentorships", ["my mentor", "مرشدي", "إرشاداتي"]),
    ("applications", ["my application", "طلباتي", "حالة طلبي"]),
    ("programs", ["my program", "برامجي"]),
]
POSSESSIVES = ["my ", "for me", "in my domain", "لي", "مجالي", "الخاص بي"]

ORDINALS = {
    1: ["الأول", "الاول", "first", "#1", "رقم 1", "رقم ١", "top"],
    2: ["التاني", "الثاني", "second", "#2", "رقم 2", "رقم ٢"],
    3: ["التالت", "الثالث", "third", "#3", "رقم 3", "رقم ٣"],
}
