"""Personal data: plain spans by rule, further ones by candidates and gradient boosting.

The base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. High-recall
generators propose more spans, which may overlap: numbers written in groups, national ids, bank
accounts, hardware and long network addresses, spelt-out emails, dates of birth. Boosted trees score
each from its format and its surroundings, and a threshold per kind, calibrated on labelled candidates
that the trees have not seen, decides. DataFrame functions only, on each row, without a shuffle.

Null texts are empty and have no spans; whole texts are read; a score at the threshold counts. Repeated
rows get repeated answers, empty tables none. Places count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchspark.llm.common import materialize
from matchspark.llm.spans import neighbourhood, rewritten, with_matches
from matchspark.llm.treecolumns import Node, read_trees, weighted_sum

_LOCAL = r"A-Za-z0-9._%+\-"
# Base patterns. Repeats are possessive and a run is entered at its start or where the last match ended:
# the same matches as the plain patterns without their second looks.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
# Generators of further candidates, in the order their kinds follow the base kinds.
GENERATORS = {
    "local_phone": r"(?<![0-9+.\-])\(?[0-9]{2,4}\)?[\x20.\-/]{1,2}[0-9]{3,4}[\x20.\-][0-9]{3,4}(?![0-9])",
    "national_id": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "bank_account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hardware": r"(?<![0-9A-Fa-f:\-])[0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:\-])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])",
    "spelt_email": r"(?i)(?<![a-z0-9])[a-z0-9._\-]{2,40}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9\-]{2,40}\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z]{2,10}(?![a-z0-9])",
    "birth_date": r"(?<![0-9./\-])(?:[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9./\-])",
}
KINDS = [*BASE, *GENERATORS]
N_LABELLED, N_ROUNDS, DEPTH = 6000, 20, 4
#: Share of true spans that a kind's threshold aims at among the selected ones.
PRECISION = 0.97
_NONE = "array<struct<start: bigint, end: bigint, kind: string>>"


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    size = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), lambda acc, i: acc + _doubled(digits, size, i))
    return total % 10 == 0


def _doubled(digits: Column, size: Column, i: Column) -> Column:
    d = F.substring(digits, i, F.lit(1)).cast("int")
    twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.coalesce(F.when((size - i) % 2 == 1, twice).otherwise(d), F.lit(0))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    size = F.length(digits_of(value))
    if kind == "ip":  # parts of any length; leading zeros don't count
        return ~F.exists(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3)
                         | (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") > 255))
    if kind == "card":
        return (size >= 14) & (size <= 19) & luhn(digits_of(value))
    if kind == "phone":
        return (size >= 10) & (size <= 15)
    return F.lit(True)


def features(kind: Column, value: Column, left: Column, right: Column) -> list[Column]:
    """Format and context of a candidate."""
    flag = lambda c: c.cast("double")
    digits = digits_of(value)
    near = F.lower(F.concat(left, F.lit(" ~ "), F.substring(right, 1, 20)))
    count = lambda pattern: (F.size(F.split(value, pattern, -1)) - 1).cast("double")
    return [
        *[flag(kind == k) for k in GENERATORS],
        F.length(value).cast("double"), F.length(digits).cast("double"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"), count("[A-Z]"), count("[a-z]"), count(r"\x20"), count("-"), count(r"\."),
        flag(value.contains("(")), F.coalesce(F.substring(digits, 1, 1).cast("double"), F.lit(-1.0)), flag(luhn(digits)),
        flag(near.rlike(r"phone|tel\b|tel[.:]|mobile|cell|call|fax|dial|whatsapp|sms|contact")),
        flag(near.rlike(r"ssn|social security|national id|tax id|passport|identity|insurance")),
        flag(near.rlike(r"iban|account|bank|transfer|swift|bic\b|deposit")),
        flag(near.rlike(r"mac\b|device|hardware|adapter|ethernet|wifi|ipv6|address|host|server|client")),
        flag(near.rlike(r"e-?mail|write|reach|mail")),
        flag(near.rlike(r"born|birth|dob\b|birthday|aged?\b")),
        flag(near.rlike(r"order|invoice|version|isbn|part|ticket|page|serial|model|tracking|number of|chapter|section|ref\b|sku|batch|lot\b")),
        flag(near.rlike(r"released|published|updated|posted|on\b|since|until|date|revision|copyright")),
        flag(left.rlike(r"[#$€£=/_]\s?$")), flag(right.rlike(r"^\s?[%$€£/=_]")), flag(left.rlike(r"[:]\s?$")),
    ]


def labelled_candidates(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """(id, kind, value, left, right, label): drawn from templates by hashes of a row number."""
    rows = materialize(spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("p"), F.col("id").cast("string")), 512)).select(
        "id", "h", F.translate("h", "abcdef", "314159").alias("d")), "drawn")
    d = lambda a, k: F.substring("d", a, k)
    x = lambda a, k: F.substring("h", a, k)
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    phone = t("(", d(1, 3), ") ", d(5, 3), "-", d(9, 4))
    plain = t(d(1, 3), "-", d(5, 3), "-", d(9, 4))
    ssn = t(d(1, 3), "-", d(5, 2), "-", d(9, 4))
    iban = t("DE", d(1, 2), " ", d(3, 4), " ", d(7, 4), " ", d(11, 4), " ", d(15, 4), " ", d(19, 2))
    code = t("AB", d(1, 2), F.upper(x(3, 4)), d(7, 4))
    mac = t(x(1, 2), ":", x(3, 2), ":", x(5, 2), ":", x(7, 2), ":", x(9, 2), ":", x(11, 2))
    ipv6 = t("2001:db8:", x(1, 4), ":", x(5, 4), "::", x(9, 4))
    spelt = t("user", d(1, 2), " [at] mail", d(3, 1), " [dot] com")
    date = t("19", d(1, 2), "-0", F.lit("5"), "-1", F.substring(d(3, 1), 1, 1))
    kinds: list[tuple[int, str, Column, str, str]] = [
        (1, "local_phone", phone, "call me at ", " any time"), (1, "local_phone", plain, "phone: ", "\n"), (1, "local_phone", phone, "tel. ", ","),
        (1, "local_phone", plain, "my mobile is ", "."), (0, "local_phone", plain, "order no ", " shipped"), (0, "local_phone", plain, "part ", " of"),
        (0, "local_phone", plain, "the sum of ", " and"), (0, "local_phone", plain, "and then ", " more"), (0, "local_phone", plain, "isbn ", "-1"),
        (1, "national_id", ssn, "SSN ", " on file"), (1, "national_id", ssn, "social security: ", "."), (1, "national_id", ssn, "tax id ", ""),
        (0, "national_id", ssn, "serial ", " in"), (0, "national_id", ssn, "ticket #", " open"), (0, "national_id", ssn, "the code ", " was"),
        (1, "bank_account", iban, "IBAN ", "\n"), (1, "bank_account", iban, "account: ", "."), (1, "bank_account", iban, "transfer to ", " today"),
        (0, "bank_account", code, "model ", " is"), (0, "bank_account", code, "batch ", ","), (0, "bank_account", code, "the ", " and"),
        (1, "hardware", mac, "device mac ", " joined"), (1, "hardware", mac, "hardware address ", "."), (0, "hardware", mac, "digest ", " is"),
        (0, "hardware", mac, "the time ", " then"), (1, "ipv6", ipv6, "client ", " said"), (1, "ipv6", ipv6, "address ", "."),
        (0, "ipv6", t(d(1, 2), ":", d(3, 2), ":", d(5, 2)), "at ", " on"), (0, "ipv6", t(d(1, 2), ":", d(3, 2), ":", d(5, 2)), "since ", ""),
        (1, "spelt_email", spelt, "write to ", " soon"), (1, "spelt_email", spelt, "", " please"), (1, "spelt_email", spelt, "email ", "."),
        (1, "birth_date", date, "born ", " in"), (1, "birth_date", date, "date of birth: ", ""), (1, "birth_date", date, "dob ", ","),
        (0, "birth_date", date, "released ", "."), (0, "birth_date", date, "updated on ", " by"), (0, "birth_date", date, "version ", ""),
        (0, "birth_date", date, "the ", " one"), (0, "birth_date", date, "since ", " it"),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), F.lit("some words before it, " + before).alias("left"),
                              F.lit(after + " and words after").alias("right"), F.lit(float(y)).alias("label"))
                     for y, k, v, before, after in kinds])
    return materialize(rows.select("id", F.element_at(each, (F.col("id") % len(kinds) + 1).cast("int")).alias("x")).select("id", "x.*"),
                       "labelled")


@dataclass(frozen=True)
class Selector:
    trees: tuple[tuple[float, Node], ...]
    threshold: dict[str, float]  # by kind


def train(spark: SparkSession, n_labelled: int = N_LABELLED, labelled: DataFrame | None = None) -> Selector:
    """Boost on two thirds of the labelled candidates, calibrate each kind's threshold on the rest."""
    rows = labelled if labelled is not None else labelled_candidates(spark, n_labelled)
    columns = features(F.col("kind"), F.col("value"), F.col("left"), F.col("right"))
    aside = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    named = rows.select("label", "kind", aside.alias("aside"), *[c.alias(f"f{i}") for i, c in enumerate(columns)])
    named = materialize(named, "features")
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(columns))], outputCol="features").transform(named.where("not aside"))
    model = GBTClassifier(maxIter=N_ROUNDS, maxDepth=DEPTH, seed=5, labelCol="label").fit(vectors.select("label", "features"))
    trees = read_trees(model.toDebugString)
    score = weighted_sum(trees, lambda i: F.col(f"f{i}"))
    kept = named.where("aside").select("kind", "label", F.round(probability(score), 3).alias("p")).groupBy("kind", "p").agg(
        F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # at most a thousand scores a kind
    threshold = {}
    for kind in GENERATORS:
        steps = sorted((r for r in kept if r["kind"] == kind), key=lambda r: -r["p"])
        good = n = 0
        threshold[kind] = 1.1  # no threshold is good enough: none is selected
        for r in steps:
            good, n = good + r["good"], n + r["n"]
            if good / n >= PRECISION and r["p"] >= 0.5:
                threshold[kind] = float(r["p"]) - 0.0005
    return Selector(tuple(trees), threshold)


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))


@lru_cache(maxsize=4)
def _selector(app: str) -> Selector:
    return train(SparkSession.getActiveSession())


def _sorted(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int")
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
                        .otherwise(rank(a) - rank(b)))


def find(docs: DataFrame, *, text_col: str = "text", selector: Selector | None = None) -> DataFrame:
    """Every row as a struct ``__row`` with ``base`` and ``spans`` (all): arrays of (start, end, kind) by start and kind."""
    selector = selector or _selector(docs.sparkSession.sparkContext.applicationId)
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    for kind, pattern in {**BASE, **GENERATORS}.items():
        df = with_matches(df, kind, "__text", pattern)

    def named(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    def holds(kind: str):
        return lambda s: base_holds(kind, s["value"])

    base = F.concat(*[F.transform(F.filter(F.col(k), holds(k)), named(k)) for k in BASE])
    text = F.col("__text")

    def candidate(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.array(*features(
            F.lit(kind), s["value"], *neighbourhood(text, s["start"], s["end"]))).alias("f"))

    offered = F.concat(*[F.transform(F.col(k), candidate(k)) for k in GENERATORS])
    df = df.select("__row", "__text", _sorted(base).alias("base"), offered.alias("offered"))
    # inside a base span a candidate has nothing to add
    fresh = F.filter("offered", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    limit = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in selector.threshold.items() for x in kv]), c["kind"])
    scored = F.transform(fresh, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
        probability(weighted_sum(list(selector.trees), lambda i: c["f"][i])).alias("p")))
    df = df.select("__row", "__text", "base", scored.alias("scored"))
    chosen = F.transform(F.filter("scored", lambda c: c["p"] >= limit(c)), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return df.select("__row", "__text", "base", _sorted(F.concat(F.col("base"), chosen)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    found = find(docs, text_col=text_col, **options)
    apart = F.filter("spans", lambda s, i: ~F.exists(F.slice("spans", F.lit(1), i), lambda o: o["end"] > s["start"]))
    new = F.when(F.col(f"__row.`{text_col}`").isNotNull(), rewritten(
        F.col("__text"), apart, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    return found.select(*[(new if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
