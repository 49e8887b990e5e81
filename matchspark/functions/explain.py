"""Explanations as column expressions: reasons, sentences, structured metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.functions import compat
from matchspark.functions.numbers import percent_text

#: A reason with one of these words is about skills; texts put together from numbers have none of them.
SKILL_WORDS = ("skill", "requirement", "specialization")


def _num(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)) if column in df.columns else F.lit(0.0)


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value computed once per row; a column that stands in several places is computed in each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ladder(place: int, *steps: tuple[Column, Column, Column | str]) -> Column:
    """The first step whose condition holds, as struct(order, place, text, skills), the heaviest first; null when none does."""
    out = None
    for cond, weight, text in steps:
        skills = isinstance(text, str) and any(word in text for word in SKILL_WORDS)
        entry = F.struct((-weight.cast("double")).alias("order"), F.lit(place).alias("place"),
                         (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(skills).alias("skills"))
        out = F.when(cond, entry) if out is None else out.when(cond, entry)
    return out


def mentor_reasons(df: DataFrame) -> Column:
    """The three strongest signals of a pair as one line; several skill reasons collapse to the first."""
    so, sc, sd = (_num(df, c) for c in ("skill_overlap_score", "skill_coverage_score", "subdomain_similarity"))
    rc, r, q = (_num(df, c) for c in ("requirement_coverage", "mentor_weighted_rating", "mentor_quality_score"))
    op, it, me = (_num(df, c) for c in ("mentor_open_post_count_log", "interaction_score_log", "mentor_more_experienced"))
    eg, country, pop = (_num(df, c) for c in ("experience_gap_abs", "same_country", "popularity_log"))
    stars = F.concat(F.lit(" ("), _one_decimal(r), F.lit("/5)"))
    w = F.lit
    groups = [
        _ladder(0, ((so >= 0.8) & (sc >= 0.8), 2.5 + so + sc, "perfect skill and expertise match"),
                ((so >= 0.7) & (sc >= 0.7), 2.2 + so + sc, "excellent skill alignment with your needs"),
                ((so >= 0.6) | (sc >= 0.7), 1.8 + so + sc, "strong skill match for your goals")),
        _ladder(1, (rc >= 0.9, 2.0 + rc, "covers all your mentorship requirements"),
                (rc >= 0.7, 1.8 + rc, "meets most of your specific requirements"),
                (rc >= 0.5, 1.4 + rc, "aligns well with your requirements")),
        _ladder(2, (sd >= 0.8, 1.8 + sd, "specializes exactly in your field"),
                (sd >= 0.6, 1.5 + sd, "strong specialization alignment"),
                (sd >= 0.4, 1.2 + sd, "relevant specialization area")),
        _ladder(3, ((r >= 4.5) & (me > 0), 1.5 + q * 0.1, F.concat(F.lit("top-rated expert mentor"), stars)),
                ((r >= 4.0) & (me > 0), 1.3 + q * 0.1, F.concat(F.lit("highly rated experienced mentor"), stars)),
                (r >= 4.0, 1.1 + q * 0.1, F.concat(F.lit("exceptionally well-reviewed"), stars)),
                (r >= 3.5, 0.9 + q * 0.05, F.concat(F.lit("strong mentor ratings"), stars))),
        _ladder(4, (op > 1, w(1.2), F.concat(F.lit("multiple open mentorship programs ("), op.cast("int").cast("string"), F.lit(")"))),
                (op > 0, w(1.0), "currently accepting mentorship applications")),
        _ladder(5, (it >= 2, 1.0 + it * 0.1, "regular engagement with their content"),
                (it >= 1, 0.8 + it * 0.1, "previous interaction with their posts"),
                (it > 0, w(0.6), "some prior engagement")),
        _ladder(6, ((so >= 0.4) & (sc >= 0.5), 0.8 + so + sc, "good skill overlap and coverage"),
                (so >= 0.4, 0.7 + so, "relevant skill overlap"),
                (sc >= 0.5, 0.6 + sc, "covers many of your skill areas")),
        _ladder(7, ((me > 0) & (eg >= 3), w(0.7), "significantly more experienced mentor"),
                ((me > 0) & (eg >= 1), w(0.5), "more experienced than your level")),
        _ladder(8, (pop > 1, w(0.25), "popular mentor in your field")),
        _ladder(9, (country > 0, w(0.2), "located in your country")),
    ]
    best = F.slice(F.sort_array(F.array_compact(F.array(*groups))), 1, 3)

    def line(kept: Column) -> Column:
        about_skills, others = F.filter(kept, lambda s: s["skills"]), F.filter(kept, lambda s: ~s["skills"])
        merged = F.when(F.size(about_skills) >= 2, F.concat(F.slice(about_skills, 1, 1), others)).otherwise(kept)
        return F.when(F.size(kept) == 0, F.lit("good overall profile fit")).otherwise(
            F.array_join(F.transform(merged, lambda s: s["text"]), "; "))

    return _held(best, line)


def _sentence(parts: Column) -> Column:
    """One part, two parts joined by with, or a list closed by and."""
    return _held(parts, _joined)


def _joined(parts: Column) -> Column:
    n = F.size(parts)
    head = F.try_element_at(parts, F.lit(1))
    head = F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substr(head, F.lit(2))))
    last = F.try_element_at(parts, F.lit(-1))
    middle = F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), ", ")
    return (F.when(n == 0, F.lit("Recommended based on your profile."))
            .when(n == 1, F.concat(head, F.lit(".")))
            .when(n == 2, F.concat(head, F.lit(" with "), last, F.lit(".")))
            .otherwise(F.concat(head, F.lit(" with "), middle, F.lit(", and "), last, F.lit("."))))


def _plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def one_sentence_reason(df: DataFrame) -> Column:
    """Skills, field, availability, rating, activity and following in one sentence."""

    def truth(name: str) -> Column:
        return _num(df, name) > 0

    domain = F.col("domain") if "domain" in df.columns else F.lit("General")
    matched = F.coalesce(F.col("matched_skills"), F.lit("")) if "matched_skills" in df.columns else F.lit("")
    rating, coverage, overlap = (_num(df, c) for c in ("average_rating", "skill_coverage_score", "skills_overlap"))
    done, opened, closed = (_num(df, c).cast("int") for c in ("completed_mentorships", "open_programs", "completed_programs"))
    star = F.concat(_one_decimal(rating), F.lit("⭐)"))
    skills = (
        F.when(truth("covers_all_skills"), F.lit("covers all your skills"))
        .when((overlap >= 0.5) & (matched != ""), F.concat(F.lit("strong match in "), matched))
        .when((overlap >= 0.3) & (matched != ""), F.concat(F.lit("shared expertise in "), matched))
        .when(coverage >= 0.5, F.concat(F.lit("covers "), percent_text(coverage), F.lit(" of your skills")))
        .when(coverage > 0, F.concat(percent_text(coverage), F.lit(" skill coverage"))))
    field = (
        F.when(truth("subdomain_match") & truth("domain_match"), F.concat(F.lit("same specialization in "), domain))
        .when(truth("subdomain_match"), F.lit("matching specialization"))
        .when(truth("domain_match"), F.concat(domain, F.lit(" domain match"))))
    availability = F.when(opened > 0, _plural(opened, "open program")).when(closed > 0, _plural(closed, "completed program"))
    trust = (F.when(rating >= 4.5, F.concat(F.lit("excellent rating ("), star))
             .when(rating >= 4.0, F.concat(F.lit("high rating ("), star))
             .when(rating >= 3.0, F.concat(F.lit("solid rating ("), star)))
    activity = (F.when(done >= 10, F.concat(done.cast("string"), F.lit(" successful mentorships")))
                .when(done >= 3, F.concat(done.cast("string"), F.lit(" completed mentorships"))))
    personal = F.when(truth("is_followed"), F.lit("mentor you follow"))
    return _sentence(F.array_compact(F.array(skills, field, availability, trust, activity, personal)))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def _level_parts(df: DataFrame) -> list[Column]:
    passed = _num(df, "target_level_pass") > 0
    return [
        F.when(passed & (_num(df, "minimum_requirement_exact_match") > 0), F.lit("exact level match"))
        .when(passed & (_num(df, "minimum_requirement_above_minimum") > 0), F.lit("exceeds minimum level")),
        F.when(_num(df, "education_level_pass") > 0, F.lit("education qualified"))]


def program_reason(df: DataFrame) -> Column:
    """Level, education, skills and domain of a program in one short line."""
    coverage = _num(df, "requirement_coverage_score")
    skills = (F.when(coverage >= 0.8, F.concat(percent_text(coverage), F.lit(" skill coverage")))
              .when(coverage >= 0.5, F.concat(percent_text(coverage), F.lit(" skill match"))))
    domain = F.trim(F.col("domain")) if "domain" in df.columns else F.lit("")
    place = F.when((domain != "") & (domain != "General"), F.concat(F.lit("in "), domain))
    parts = F.array_compact(F.array(*_level_parts(df), skills, place))
    line = F.concat(_capital(F.array_join(parts, "; ")), F.lit("."))
    return F.when(F.size(parts) == 0, F.lit("Matches your profile.")).otherwise(line)


def program_chat_reason(df: DataFrame) -> Column:
    """The chat variant: level, education, skills and days left."""
    coverage = _num(df, "requirement_coverage_score")
    days = _num(df, "days_until_deadline").cast("int") if "days_until_deadline" in df.columns else F.lit(999)
    days = F.when(days == 0, 999).otherwise(days)
    skills = F.when(coverage >= 0.5, F.concat(percent_text(coverage), F.lit(" skill coverage")))
    closing = F.when(days < 999, F.when(days <= 0, F.lit("⏰ closing soon")).when(days == 1, F.lit("⏰ 1 day left"))
                     .otherwise(F.concat(F.lit("⏰ "), days.cast("string"), F.lit(" days left"))))
    parts = F.array_compact(F.array(*_level_parts(df), skills, closing))
    line = F.concat(_capital(F.array_join(parts, "; ")), F.lit("."))
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(line)


def program_metadata(df: DataFrame, score: str = "rerank_score") -> Column:
    """Fit band, signals, risk flags and the numbers behind a program recommendation."""
    from matchspark.plans.rerank import program_confidence
    coverage, overlap = _num(df, "requirement_coverage_score"), _num(df, "requirement_overlap_score")
    target, education = _num(df, "target_level_gap").cast("int"), _num(df, "education_level_gap").cast("int")
    missing = _num(df, "missing_required_skill_count").cast("int")
    soft = _num(df, "overall_eligibility_softness")
    exact = _num(df, "minimum_requirement_exact_match") > 0
    band = compat.fit_band(soft)
    if "compatibility_confidence_band" in df.columns:
        band = F.coalesce(F.nullif(F.col("compatibility_confidence_band"), F.lit("")), band)
    far = (F.abs(target) >= 3) | (F.abs(education) >= 3)
    signals = F.array_compact(F.array(
        F.when(coverage >= 0.6, F.lit("skill_coverage_high")).when(coverage >= 0.2, F.lit("skill_coverage_partial")),
        F.when(overlap >= 0.3, F.lit("skill_overlap_good")),
        F.when((target == 0) & (education == 0), F.lit("level_exact"))
        .when((F.abs(target) <= 1) & (F.abs(education) <= 1), F.lit("level_near")).when(far, F.lit("level_gap_large")),
        F.when(missing > 0, F.lit("missing_required_skills")),
        F.when(exact, F.lit("minimum_exact"))
        .when(_num(df, "minimum_requirement_above_minimum") > 0, F.lit("above_minimum"))))
    risks = F.array_compact(F.array(
        F.when(band == "weak_fit", F.lit("weak_fit")), F.when(F.abs(target) >= 3, F.lit("target_gap_large")),
        F.when(F.abs(education) >= 3, F.lit("education_gap_large")), F.when(missing >= 3, F.lit("missing_skills_high"))))
    return F.struct(
        band.alias("fit_band"), signals.alias("signals"), risks.alias("risk_flags"),
        F.bround(coverage, 3).alias("skill_coverage"), F.bround(overlap, 3).alias("skill_overlap"),
        target.alias("target_level_gap"), education.alias("education_level_gap"),
        missing.alias("missing_required_skills"), F.bround(soft, 3).alias("overall_softness"),
        F.bround(_num(df, "program_popularity_log"), 3).alias("popularity_contribution"),
        exact.alias("minimum_requirement_exact_match"), program_confidence(df, score).alias("confidence"))


def detailed_explanation(name: Column, match: Column, reason: Column, domain: Column, language: str = "en") -> Column:
    """Bullet points recovered from the one-sentence reason, in English or Arabic."""
    return _held(F.coalesce(reason, F.lit("")), lambda text: _held(
        F.lower(text), lambda r: _points(name, match, text, r, domain, language)))


def _points(name: Column, match: Column, reason: Column, r: Column, domain: Column, language: str) -> Column:
    """The bullet points of a reason; ``r`` is the reason in lower case."""
    # fixed values: condition, mark, English, Arabic
    skills = F.rtrim(F.regexp_replace(F.regexp_extract(reason, r"^.*in (.*)$", 1),
                                      r"( with.*|,.*)$", ""), F.lit("."))
    known = F.coalesce(domain, F.lit("General")) != "General"
    rows = [
        (r.contains("covers all your skills"), "✅", F.lit("Covers all the skills you're interested in"),
         F.lit("بيغطي كل المهارات اللي أنت مهتم بيها")),
        (~r.contains("covers all your skills") & r.rlike("strong match|shared expertise") & (skills != ""), "🎯",
         F.concat(F.lit("Strong skill match: "), skills), F.concat(F.lit("تطابق قوي في المهارات: "), skills)),
        (~r.contains("covers all your skills") & ~r.rlike("strong match|shared expertise") & r.rlike("skill coverage|covers"),
         "📊", F.lit("Good coverage of your required skills"), F.lit("تغطية جيدة لمهاراتك المطلوبة")),
        (known & r.rlike("same specialization|matching specialization"), "🏷️",
         F.concat(F.lit("Same specialization as yours in "), domain), F.concat(F.lit("نفس التخصص بتاعك في "), domain)),
        (known & ~r.rlike("same specialization|matching specialization") & r.contains("domain match"), "🏷️",
         F.concat(F.lit("Same domain as yours ("), domain, F.lit(")")),
         F.concat(F.lit("نفس مجال اهتمامك ("), domain, F.lit(")"))),
        (r.contains("open program"), "📂", F.lit("Has open programs right now — ready to start"),
         F.lit("عنده برامج مفتوحة حالياً — يقدر يبدأ معاك")),
        (~r.contains("open program") & r.contains("completed program"), "✔️",
         F.lit("Has experience from previous mentorship programs"), F.lit("عنده خبرة في برامج إرشاد سابقة")),
        (r.rlike("excellent rating|high rating|solid rating"), "⭐", F.lit("Highly rated by previous mentees"),
         F.lit("تقييماته مرتفعة من المتدربين السابقين")),
        (r.rlike("successful mentorship|completed mentorship"), "🏆", F.lit("Strong track record of successful mentorships"),
         F.lit("عنده سجل قوي من الإرشاد الناجح")),
        (r.contains("you follow"), "👤", F.lit("You're already following this mentor"),
         F.lit("أنت بالفعل متابعه على المنصة")),
    ]
    pick = 3 if language == "ar" else 2
    bullets = F.array_compact(F.array(*[
        F.when(row[0], F.concat(F.lit(f"  {row[1]} "), row[pick])) for row in rows]))
    fallback = F.when(reason != "", F.array(F.concat(F.lit("  💡 "), reason))).otherwise(
        F.array().cast("array<string>"))
    pct = match.cast("int").cast("string")
    if language == "ar":
        head = F.concat(F.lit("تم ترشيح **"), name, F.lit("** (نسبة التوافق: "), pct, F.lit("%) للأسباب دي:"))
        plain = F.concat(F.lit("تم ترشيح **"), name, F.lit("** بنسبة توافق "), pct, F.lit("% بناءً على بروفايلك."))
    else:
        head = F.concat(F.lit("**"), name, F.lit("** was recommended (match: "), pct, F.lit("%) because:"))
        plain = F.concat(F.lit("**"), name, F.lit("** was recommended with a "), pct, F.lit("% match based on your profile."))

    def whole(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(head), lines), "\n")).otherwise(plain)

    return _held(bullets, lambda b: _held(F.when(F.size(b) > 0, b).otherwise(fallback), whole))
