"""Text rules on known messages."""

import pytest
from pyspark.sql import functions as F

from matchspark.functions import explain, lexicon, text
from matchspark.plans import chat

#: Own messages, labels by hand: each rule in both languages, some that several rules could claim.
GOLDENS = [
    ("hello everyone, first day here", "greeting"), ("صباح الخير يا جماعة", "greeting"), ("sup", "greeting"),
    ("وصلني بلاغ ضد حد في الجروب", "complaint"), ("شكوى بخصوص موعد الجلسة", "complaint"),
    ("الفيديو مش شغال عندي من امبارح", "support_request"), ("الصفحة مش راضية تحمل خالص", "support_request"),
    ("آخر تسليم للمشروع يوم الخميس ولا الجمعة", "submit_task"), ("نسيت الموعد النهائي للمشروع", "submit_task"),
    ("stuck on the second assignment since monday", "task_help"), ("الواجب بتاع الأسبوع ده صعب", "task_help"),
    ("ابعتلي مقال عن قواعد البيانات", "materials_request"), ("في دورة كويسة عن الشبكات", "materials_request"),
    ("ليه اخترت الشخص ده بالذات ليا", "recommendation_explanation"), ("ليه رشحت سارة مش منى", "recommendation_explanation"),
    ("يعني ايه حلقة تكرار", "general_question"), ("معنى كلمة خوارزمية", "general_question"),
    ("draw me a study plan for databases", "roadmap_request"), ("محتاج خطة تعلم للأمن السيبراني", "roadmap_request"),
    ("اقترح برامج صيفية قصيرة", "ask_program_recommendation"), ("رشحلي برنامج للمبتدئين", "ask_program_recommendation"),
    ("recommend me someone patient", "ask_mentor_recommendation"), ("محتاج توصية بحد يتابعني", "ask_mentor_recommendation"),
    ("البرنامج ده كام ساعة في الأسبوع", "faq"), ("سعر الاشتراك بالدولار", "faq"),
    ("عايز مرشد يعرف شبكات", "find_mentor"), ("ابغى حد يراجع معايا", "find_mentor"),
    ("who is the president of france", "off_topic"), ("will the weather be hot tomorrow", "off_topic"),
    ("شكوى من فيديو في دورة الشبكات", "complaint"), ("الكود مش شغال في الواجب", "support_request"),
    ("تسليم الواجب بيتم فين", "submit_task"), ("مقال فيه خريطة كاملة للمجال", "materials_request"),
]


def test_mentee_intents(spark):
    df = spark.createDataFrame(GOLDENS, "text string, want string").withColumn("got", text.mentee_intent(F.col("text")))
    wrong = [(r.text, r.want, r.got) for r in df.collect() if r.want != r.got]
    assert not wrong


def test_intent_from_reply(spark):
    cases = [('{"intent": "recommendation_explanation"}', "recommendation_explanation"), ("noise {\"intent\":\"faq\"} noise", "faq"),
             ("'greeting'", "greeting"), ("explanation_request", "general_question"), ("nothing here", None)]
    df = spark.createDataFrame(cases, "t string, want string")
    got = df.withColumn("got", text.intent_from_reply(F.col("t"), lexicon.MENTEE_INTENTS, lexicon.INTENT_ALIASES)).collect()
    assert all(r.want == r.got for r in got)


def test_white_space_of_any_kind_is_stripped(spark):
    df = spark.createDataFrame([("\t\nhello there",), ("\n\r\n",)], "text string")
    got = df.select(text.mentee_intent(F.col("text")), text.sentiment(F.col("text"))["confidence"]).collect()
    assert got[0][0] == "greeting" and got[1][1] == 1.0


def test_long_feedback_stays_whole(spark):
    long = "useful words " * 200 + "end"
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(text.clean_feedback(F.col("t"))).first()[0] == long


def test_sentiment_and_satisfaction(spark):
    df = spark.createDataFrame([("Great mentor", 5), ("not helpful", 4), ("", 3), ("ok", 5)], "text string, rating int")
    labels = [r[0] for r in df.select(text.sentiment(F.col("text"))["label"]).collect()]
    assert labels == ["positive", "neutral", "neutral", "neutral"]
    sat = [round(r[0], 3) for r in df.select(text.satisfaction(F.col("rating"), F.lit("negative"))).collect()]
    assert sat == [0.7, 0.5, 0.3, 0.7]


def test_clean_feedback(spark):
    df = spark.createDataFrame([("  -- good   work ....  really , yes ( nice )  ok ",), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_feedback(F.col("t"))).collect()] == ["good work. really, yes ( nice ) ok", "", ""]


def test_faq_matches(spark):
    faq = spark.createDataFrame([(1, "register"), (1, "sign up"), (2, "free"), (2, "fee"), (3, "Price")], "entry_id long, keyword string")
    msgs = spark.createDataFrame([(1, "How to REGISTER or sign up"), (2, "is it free?"), (3, "fee"), (4, "what price")], "message_id long, text string")
    got = {r.message_id: (r.entry_id, r.score) for r in chat.match_faq(msgs, faq).collect()}
    assert got == {1: (1, 15), 2: (2, 4), 3: (None, None), 4: (3, 5)}
    # far more keywords than one row could test
    many = faq.union(spark.range(3000).select(F.col("id") + 10, F.format_string("word%05d", "id")))
    assert {r.message_id: (r.entry_id, r.score) for r in chat.match_faq(msgs, many).collect()} == got


def test_mentioned_mentor(spark):
    recs = spark.createDataFrame([(m, i + 1, 10 + i, n) for m in (1, 2, 3, 4) for i, n in enumerate(["Ahmed Ali", "Sara Omar", "Mona"])],
                                 "message_id long, rank int, mentor_id long, mentor_name string")
    msgs = spark.createDataFrame([(1, "why Sara Omar?"), (2, "tell me about omar"), (3, "ايه رأيك في التالت"), (4, "hello")], "message_id long, text string")
    got = {r.message_id: r.mentor_id for r in chat.mentioned_mentor(msgs, recs).collect()}
    assert got == {1: 11, 2: 11, 3: 12}


def test_reasons(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.9, 4.6, 1), (0.0, 0.0, 0.0, 0.0, 0)],
                               "skill_overlap_score double, skill_coverage_score double, subdomain_similarity double, mentor_weighted_rating double, mentor_more_experienced int")
    got = [r[0] for r in df.select(explain.mentor_reasons(df)).collect()]
    assert got == ["perfect skill and expertise match; specializes exactly in your field", "good overall profile fit"]
    rec = spark.createDataFrame([(1, "Python", 0.6, 12, 4.7)], "subdomain_match int, matched_skills string, skills_overlap double, completed_mentorships int, average_rating double")
    assert rec.select(explain.one_sentence_reason(rec)).first()[0] == \
        "Strong match in python with matching specialization, excellent rating (4.7⭐), and 12 successful mentorships."


@pytest.mark.parametrize("lang", ["en", "ar"])
def test_detailed_explanation(spark, lang):
    df = spark.createDataFrame([("Covers all your skills with 2 open programs.",)], "r string")
    out = df.select(explain.detailed_explanation(F.lit("Mona"), F.lit(91), F.col("r"), F.lit("General"), lang)).first()[0]
    assert "Mona" in out and "91" in out and out.count("\n") == 2


def test_explanations_compute_each_part_once(spark):
    """Reasons, points and sentences stand in the plan once, however often the result needs them."""
    df = spark.createDataFrame([(0.0, 0.0, 0.5, 4.6, 1, "Strong match in python.")], "skill_overlap_score double, skill_coverage_score double, "
                               "subdomain_similarity double, mentor_weighted_rating double, mentor_more_experienced int, r string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().rsplit("LogicalRDD", 1)[0]
    for c, part in ((explain.mentor_reasons(df), "top-rated expert mentor"), (explain.one_sentence_reason(df), "mentor you follow"),
                    (explain.detailed_explanation(F.lit("Mona"), F.lit(91), F.col("r"), F.lit("Data")), "Highly rated by previous mentees")):
        assert plan(c).count(part) == 1
    assert df.select(explain.mentor_reasons(df)).first()[0] == \
        "relevant specialization area; top-rated expert mentor (4.6/5)"


def test_sites(spark):
    df = spark.createDataFrame([("roadmap", "deep learning", "en"), ("other", "x", "ar")], "i string, t string, l string")
    got = [r[0] for r in df.select(text.source_sites(F.col("i"), F.col("t"), F.col("l"))).collect()]
    assert got[0][:5] == lexicon.INTENT_SITES["roadmap"] and len(got[0]) == 6
    assert got[1][0] == "stackoverflow.com" and len(set(got[1])) == 6
