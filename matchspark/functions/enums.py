"""Vocabulary normalisation as CASE expressions (codegen friendly, no lookups at run time)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def word(c: Column) -> Column:
    """The comparable form of a label: text, trimmed, lower case."""
    return F.lower(F.trim(c.cast("string")))


def map_enum(c: Column, mapping: Mapping[object, Sequence[str]], default: object = None) -> Column:
    """``mapping`` goes from the target value to the accepted spellings of the source label."""
    key = word(c)
    out = None
    for target, spellings in mapping.items():
        cond = key.isin(*spellings)
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return out.otherwise(F.lit(default)) if default is not None else out


# ---------------------------------------------------------------- fixed values
EXPERIENCE = {"none": 1, "beginner": 2, "intermediate": 3, "advanced": 4}
EXPERIENCE_SPELLINGS = {
    "beginner": ["beginner", "junior", "2"],
    "intermediate": ["intermediate", "mid", "3"],
    "advanced": ["advanced", "senior", "4"],
}
EDUCATION = {"freshman": 1, "sophomore": 2, "junior": 3, "senior": 4, "graduate": 5}

POST_STATUS = {"Draft": ["draft"]}
TARGET_LEVEL = {
    "Beginner": ["beginner", "no_experience", "none", "1"],
    "Junior": ["junior", "2"],
    "Mid": ["mid", "intermediate", "3"],
    "Senior": ["senior", "advanced", "4"],
}
EDUCATION_LEVEL = {
    "Freshman": ["freshman", "1"],
    "Sophomore": ["sophomore", "2"],
    "Junior": ["junior", "3"],
    "Senior": ["senior", "4"],
    "Graduate": ["graduate", "professional", "5"],
}
APPLICATION_STATUS = {
    "Accepted": ["accepted"],
    "Rejected": ["rejected", "canceled", "cancelled"],
    "Pending": ["pending", "alerted"],
}
MENTORSHIP_STATUS = {
    "Active": ["active"],
    "Completed": ["completed"],
    "Cancelled": ["cancelled", "canceled"],
}
EXPERIENCE_NAME = {
    "None": ["none", "no_experience", "1"],
    "Beginner": ["beginner", "junior", "2"],
    "Intermediate": ["mid", "intermediate", "3"],
    "Advanced": ["advanced", "senior", "4"],
}
CANCELLATION_REASONS = [
    "ScheduleConflict", "AcceptedOtherOffer", "LostInterest", "AvailabilityChanged",
    "TimeZoneIssue", "NotReadyYet", "PersonalIssue", "ApplicationSentByMistake",
]
CANCELLATION_ACTOR = {"1": ["mentor"], "2": ["mentee"]}
ROLE = {"1": ["mentee"], "2": ["mentor"], "3": ["admin"]}
CURRENT_LEVEL_CODE = {
    "1": ["beginner"], "2": ["junior"], "3": ["mid", "intermediate"], "4": ["senior", "advanced"],
}
EXPERIENCE_LEVEL_CODE = {
    "1": ["none", "no_experience"], "2": ["beginner"], "3": ["intermediate", "mid"],
    "4": ["advanced", "senior"],
}
EDUCATION_STATUS_CODE = {
    "1": ["freshman"], "2": ["sophomore"], "3": ["junior"], "4": ["senior"],
    "5": ["graduate", "professional"],
}
LEVEL_BAND_SPELLINGS = {
    "Beginner": ["beginner", "entry", "introductory"],
    "Junior": ["junior", "early", "early career"],
    "Mid": ["mid", "intermediate", "middle"],
    "Senior": ["senior", "advanced", "expert"],
}
PUBLISHED = ["published"]
OPEN_AVAILABILITY = ["open", "opened"]
PROGRAM_PUBLISHED = ["published", "1"]
CLOSED_AVAILABILITY = ["closed", "inactive", "unavailable", "archived"]
# -----------------------------------------------------------------------------


def normalize_experience(c: Column) -> Column:
    """Canonical experience word. Aliases and enum numbers count, everything else is ``none``."""
    return map_enum(c, EXPERIENCE_SPELLINGS, "none")


def experience_num(c: Column) -> Column:
    """Canonical word to 1..4; unknown is 1."""
    return map_enum(c, {n: [w] for w, n in EXPERIENCE.items()}, 1)


def encode_profile_level(c: Column) -> Column:
    """Profile level to 1..4: words and aliases first, then numbers rounded half to even."""
    key = word(c)
    number = F.bround(key.try_cast("double")).try_cast("int")
    by_number = F.when(number.between(2, 4), number).otherwise(F.lit(1))
    named = normalize_experience(c)
    return F.when(named != "none", experience_num(named)).otherwise(by_number).cast("int")


def experience_word(num: Column) -> Column:
    out = None
    for name, n in EXPERIENCE.items():
        out = F.when(num == n, F.lit(name)) if out is None else out.when(num == n, F.lit(name))
    return out.otherwise(F.lit("none"))


def _ordinal(c: Column, names: Mapping[str, int], default: int) -> Column:
    """Name lookup, else the number itself, else the default."""
    named = map_enum(c, {n: [w] for w, n in names.items()})
    return F.coalesce(named, word(c).try_cast("double").try_cast("int"), F.lit(default)).cast("int")


def level_num(c: Column) -> Column:
    """Target level or required skill level to a number; unknown is 1."""
    return _ordinal(c, EXPERIENCE, 1)


def education_num(c: Column) -> Column:
    """Education word or number; unknown is 0."""
    return _ordinal(c, EDUCATION, 0)


def post_status(c: Column) -> Column:
    return map_enum(c, POST_STATUS, "Published")


def target_level(c: Column) -> Column:
    return map_enum(c, TARGET_LEVEL, "Beginner")


def education_level(c: Column) -> Column:
    return map_enum(c, EDUCATION_LEVEL, "Graduate")


def application_status(c: Column) -> Column:
    return map_enum(c, APPLICATION_STATUS, "Pending")


def mentorship_status(c: Column) -> Column:
    return map_enum(c, MENTORSHIP_STATUS, "Active")


def meets_requirements(c: Column) -> Column:
    return F.when(word(c) == "alerted", F.lit("0")).otherwise(F.lit("1"))


def experience_name(c: Column) -> Column:
    return map_enum(c, EXPERIENCE_NAME, "Beginner")


def cancellation_reason(c: Column) -> Column:
    """``schedule_conflict`` and ``ScheduleConflict`` both give the enum name."""
    squeezed = F.regexp_replace(word(c), "_", "")
    return map_enum(squeezed, {name: [name.lower()] for name in CANCELLATION_REASONS}, "PersonalIssue")


def cancellation_actor_code(c: Column) -> Column:
    return map_enum(c, CANCELLATION_ACTOR, "2")


def cancellation_actor_name(c: Column) -> Column:
    """Stored actor codes 1/2 back to words; other text passes through in lower case."""
    key = word(c)
    return F.when(key == "1", F.lit("mentor")).when(key == "2", F.lit("mentee")).otherwise(key)


def enum_label(c: Column) -> Column:
    """Clean label: ``nan``, ``none`` and ``null`` count as empty."""
    key = F.coalesce(word(c), F.lit(""))
    return F.when(key.isin("nan", "none", "null"), F.lit("")).otherwise(key)


def level_band(c: Column) -> Column:
    return map_enum(c, LEVEL_BAND_SPELLINGS, "Unknown")


def band_accepts(mentee_level: Column, program_level: Column) -> Column:
    """Exact or adjacent band; an unknown level on either side passes."""
    order = {name: i for i, name in enumerate(LEVEL_BAND_SPELLINGS)}
    rank = {i: [name.lower()] for name, i in order.items()}
    mine = map_enum(level_band(mentee_level), rank)
    theirs = map_enum(level_band(program_level), rank)
    return F.coalesce(F.abs(mine - theirs) <= 1, F.lit(True))


def is_published(c: Column) -> Column:
    return word(c).isin(*PUBLISHED)


def is_open_availability(c: Column) -> Column:
    return word(c).isin(*OPEN_AVAILABILITY)


def program_is_open(c: Column) -> Column:
    """Publication state of a program; a missing value is not published."""
    return F.when(word(c).isin(*PROGRAM_PUBLISHED), 1).otherwise(0)


def program_is_available(c: Column) -> Column:
    """Anything that is not on the closed list counts as available."""
    return F.when(word(c).isin(*CLOSED_AVAILABILITY), 0).otherwise(1)
