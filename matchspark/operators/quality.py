"""Data-quality rules: reconciliation, integrity over time, schema, ranges, drift, manifests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from matchspark.functions import enums
from matchspark.functions.numbers import finite, flag
from matchspark.operators.quantiles import quantiles_long
from matchspark.schemas import plain
from matchspark.session import materialize

# ---------------------------------------------------------------- fixed values
LEAKAGE_NAMES = {
    "future_clicks", "future_applications", "accepted_after_split", "future_popularity",
    "future_interactions", "post_split_statistics", "post_split_stats", "evaluation_only_column"}
LEAKAGE_PATTERNS = [r"^future_", r"^post_split_", r"^after_split", r"^eval_(?!uation)", r"leakage",
                    r"^label_future", r"_after_split$"]
RATIO_COLUMNS = {
    "requirement_coverage_score", "requirement_overlap_score", "required_skill_level_match_score",
    "candidate_pre_score", "cf_score", "cf_confidence", "target_level_softness", "education_softness",
    "skill_level_compatibility", "overall_eligibility_softness"}
COUNT_COLUMNS = {
    "matched_required_skill_count", "missing_required_skill_count", "program_enrollment_count", "spots_left",
    "capacity", "target_level_distance", "education_distance", "days_until_deadline"}
BINARY_COLUMNS = {
    "is_open", "target_level_pass", "education_level_pass", "target_level_exact_match",
    "education_level_exact_match", "minimum_requirement_exact_match", "minimum_requirement_above_minimum",
    "eligibility_pass", "deadline_passed"}
POPULARITY_COLUMNS = {"program_popularity_log", "program_difficulty_score"}
ID_COLUMNS = {"mentee_id", "post_id", "mentor_id"}
LABEL_COLUMNS = {"label", "time_split", "label_weight"}
INTERNAL_COLUMNS = {"hardness_score", "compatibility_confidence_band"}
OUTLIER_IQRS = 6.0
NAN_SPIKE = {"times": 2.0, "plus": 0.10, "floor": 0.05}
MEDIAN_DRIFT = 2.0
SPIKE_TIMES = 3
# -----------------------------------------------------------------------------


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target row counts side by side; a missing target counts as a mismatch."""
    joined = source.select("name", F.col("rows").alias("expected")).join(
        target.select("name", F.col("rows").alias("loaded")), "name", "full")
    return joined.select("name", F.coalesce("expected", F.lit(-1)).alias("expected"),
                         F.coalesce("loaded", F.lit(-1)).alias("loaded"),
                         F.col("expected").eqNullSafe(F.col("loaded")).alias("matches"))


def inventory(tables: Mapping[str, DataFrame], required: Iterable[str]) -> DataFrame:
    """Row count per required table, -1 where it is missing."""
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in required], "name string")
    found = row_counts({n: tables[n] for n in required if n in tables})
    return names.join(found, "name", "left").select("name", F.coalesce("rows", F.lit(-1)).alias("rows"))


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per required column: is it there, and how many values are empty."""
    actual = {plain(c): c for c in df.columns}
    checks = []
    for n in names:
        c = actual.get(plain(n))
        empty = F.lit(None).cast("bigint") if c is None else F.sum(
            flag(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""))
        checks.append(F.struct(F.lit(n).alias("column"), F.lit(c is not None).alias("present"),
                               F.coalesce(empty, F.lit(0)).alias("empty_values")))
    return df.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def null_ids(df: DataFrame, columns: Sequence[str] = ("mentee_id", "mentor_id")) -> DataFrame:
    return df.agg(*[F.sum(flag(F.col(c).isNull())).alias(f"{c}_nulls") for c in columns])


def require_ids(df: DataFrame, columns: Sequence[str] = ("mentee_id", "mentor_id")) -> None:
    row = null_ids(df, columns).first()
    bad = {c: n for c, n in zip(columns, row) if n}
    if bad:
        raise ValueError(f"null ids: {bad}")


def before_parent(events: DataFrame, parents: DataFrame, key: str, time: str, parent_time: str = "created_at") -> DataFrame:
    """How many events are older than the row they belong to."""
    created = parents.select(key, F.col(parent_time).cast("timestamp").alias("_created"))
    late = F.col(time).cast("timestamp") < F.col("_created")
    return events.join(created, key).agg(F.sum(flag(late)).alias("violations"))


def _rule(name: str, df: DataFrame, cond: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("rule"), F.sum(flag(cond)).alias("violations"))


def integrity_report(applications: DataFrame, posts: DataFrame, mentorships: DataFrame,
                     engagement: DataFrame | None, now: Column) -> DataFrame:
    """The chronological and status rules V1..V6 with their violation counts."""
    status = enums.word(F.col("status"))
    applied, decided = F.col("applied_at").cast("timestamp"), F.col("decisioned_at").cast("timestamp")
    start, end = F.col("start_date").cast("timestamp"), F.col("end_date").cast("timestamp")
    rules = [
        before_parent(applications, posts, "post_id", "applied_at").select(F.lit("V1").alias("rule"), "violations"),
        _rule("V2", applications, decided < applied),
        _rule("V3a", mentorships, (status == "completed") & (end > now)),
        _rule("V3b", mentorships, (status == "active") & (end < now)),
        _rule("V3c", mentorships, end < start),
        _rule("V6", applications, (status == "pending") & decided.isNotNull()),
    ]
    if "meet_requirements" in applications.columns:
        rules.append(_rule("V5a", applications, status.isin("accepted", "rejected") & (F.col("meet_requirements") == 0)))
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    if engagement is not None:
        created = posts.select("post_id", F.col("created_at").cast("timestamp").alias("_created"))
        per_kind = engagement.join(created, "post_id").groupBy("kind").agg(
            F.sum(flag(F.col("event_time").cast("timestamp") < F.col("_created"))).alias("violations"))
        out = out.union(per_kind.select(F.concat(F.lit("V4 "), F.col("kind")).alias("rule"), "violations"))
    return out


def requirement_distribution(applications: DataFrame) -> DataFrame:
    """Pending applications per requirement flag (information only)."""
    pending = applications.where(enums.word(F.col("status")) == "pending")
    return pending.groupBy("meet_requirements").agg(F.count("*").alias("applications"))


def future_rows(df: DataFrame, time: str, limit: Column) -> DataFrame:
    return df.agg(F.sum(flag(F.col(time).cast("timestamp") > limit)).alias("future_rows"))


def leakage_columns(columns: Iterable[str]) -> list[str]:
    """Columns that look as if they carry information from after the split."""
    return [c for c in columns
            if c in LEAKAGE_NAMES or any(re.search(p, c.lower()) for p in LEAKAGE_PATTERNS)]


def reject_leakage(df: DataFrame) -> DataFrame:
    found = leakage_columns(df.columns)
    if found:
        raise ValueError(f"leakage columns: {found}")
    return df


def schema_report(df: DataFrame, expected: Sequence[str], required: Sequence[str],
                  families: Mapping[str, str] | None = None, allow_extra: bool = False) -> dict[str, list[str]]:
    """Duplicate, missing, unexpected and mistyped columns; anything not allowed raises."""
    seen, duplicates = set(), []
    for c in df.columns:
        if c in seen:
            duplicates.append(c)
        seen.add(c)
    kinds = {"numeric": NumericType, "string": StringType}
    mistyped = [f.name for f in df.schema.fields
                if f.name in (families or {}) and not isinstance(f.dataType, kinds[families[f.name]])]
    report = {
        "duplicates": duplicates, "missing_required": [c for c in required if c not in seen],
        "missing_expected": [c for c in expected if c not in seen],
        "unexpected": [c for c in df.columns if c not in set(expected)],
        "dtype_mismatches": mistyped, "leakage_present": leakage_columns(df.columns)}
    fatal = [k for k in ("duplicates", "missing_required", "dtype_mismatches", "leakage_present") if report[k]]
    if report["unexpected"] and not allow_extra:
        fatal.append("unexpected")
    if fatal:
        raise ValueError(f"schema check failed: { {k: report[k] for k in fatal} }")
    return report


def is_count(column: str) -> bool:
    return column.lower().endswith(("_count", "_counts")) or column in COUNT_COLUMNS


def range_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: negative counts, ratios outside 0..1 and values beyond six interquartile ranges."""
    q = quantiles_long(df.select(*[finite(F.col(c)).alias(c) for c in columns]), columns, [0.25, 0.75])
    bounds = q.groupBy("name").agg(F.min("value").alias("q1"), F.max("value").alias("q3")).agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("q1", "q3"))))).scalar()
    held = df.select(*columns, bounds.alias("_q"))
    checks = []
    for c in columns:
        x, b = finite(F.col(c)), F.try_element_at(F.col("_q"), F.lit(c))
        iqr = b["q3"] - b["q1"]
        outlier = (iqr > 0) & ((x < b["q1"] - OUTLIER_IQRS * iqr) | (x > b["q3"] + OUTLIER_IQRS * iqr))
        checks.append(F.struct(
            F.lit(c).alias("column"),
            F.sum(flag(x < 0) if is_count(c) else F.lit(0)).alias("negative"),
            F.sum(flag((x < 0) | (x > 1)) if c in RATIO_COLUMNS else F.lit(0)).alias("out_of_range"),
            F.sum(flag(outlier)).alias("outliers")))
    return held.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def clip_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts to at least 0, ratios to 0..1."""
    out = df
    for c in columns:
        x = F.col(c)
        if is_count(c):
            out = out.withColumn(c, F.when(x < 0, F.lit(0)).otherwise(x))
        elif c in RATIO_COLUMNS:
            out = out.withColumn(c, F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x))
    return out


def drift_report(train: DataFrame, evaluation: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing shares, medians, zero variance, missing-value spike and median drift."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        shares = [F.avg(flag(F.col(c).isNull()).cast("double")).alias(c) for c in columns]
        flat = [(F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True))).alias(f"_flat_{c}") for c in columns]
        rows = ", ".join(f"'{c}', `{c}`, `_flat_{c}`" for c in columns)
        stats = df.agg(*shares, *flat).selectExpr(f"stack({len(columns)}, {rows}) AS (name, {tag}_missing, {tag}_flat)")
        medians = quantiles_long(df, columns, [0.5]).select("name", F.col("value").alias(f"{tag}_median"))
        return stats.join(medians, "name", "left")

    joined = side(train, "train").join(side(evaluation, "eval"), "name")
    tm, em = F.col("train_missing"), F.col("eval_missing")
    spike = (em > F.greatest(tm * NAN_SPIKE["times"], tm + NAN_SPIKE["plus"])) & (em > NAN_SPIKE["floor"])
    shift = F.abs(F.col("eval_median") - F.col("train_median")) / (F.abs("train_median") + 1e-9)
    return joined.select(
        F.col("name").alias("column"), "train_missing", "eval_missing", "train_median", "eval_median",
        F.col("train_flat").alias("zero_variance"), spike.alias("missing_spike"),
        F.coalesce(shift > MEDIAN_DRIFT, F.lit(False)).alias("median_drift"))


def distribution_warnings(pairs: DataFrame, min_rows: int = 0, min_spike_rows: int = 0) -> DataFrame:
    """Warnings about negative counts, ratios out of range, constant features and a popularity spike.

    The last two are only given for more rows than ``min_rows`` and ``min_spike_rows``.
    """
    numeric = [f.name for f in pairs.schema.fields if isinstance(f.dataType, NumericType)
               and f.name not in ID_COLUMNS | {"label"}]
    parts = []
    for c in numeric:
        x = F.col(c)
        if c.endswith("_count"):
            n = F.sum(flag(x < 0))
            parts.append(F.when(n > 0, F.concat(F.lit(f"{c}: "), n.cast("string"), F.lit(" negative values"))))
        if c in RATIO_COLUMNS:
            n = F.sum(flag((x < -0.01) | (x > 1.01)))
            parts.append(F.when(n > 0, F.concat(F.lit(f"{c}: "), n.cast("string"), F.lit(" values out of range"))))
        same = F.coalesce(F.min(x).eqNullSafe(F.max(x)), F.lit(True))
        parts.append(F.when(same & (F.count("*") > min_rows), F.lit(f"{c}: zero variance")))
    if "program_popularity_log" in pairs.columns:
        top = quantiles_long(pairs, ["program_popularity_log"], [0.99]).select("value").scalar()
        spike = (F.max("program_popularity_log") > F.max("_p99") * SPIKE_TIMES) & (F.count("*") > min_spike_rows)
        parts.append(F.when(spike, F.lit("program_popularity_log: unstable spike")))
        pairs = pairs.select("*", top.alias("_p99"))
    return pairs.agg(F.array_compact(F.array(*parts)).alias("w")).select(F.explode("w").alias("warning"))


def undeclared_binary(df: DataFrame, declared: Iterable[str] = BINARY_COLUMNS) -> DataFrame:
    """Numeric columns that only hold 0 and 1 although nobody declared them binary."""
    skip = set(declared) | ID_COLUMNS | LABEL_COLUMNS
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
    checks = [F.struct(F.lit(c).alias("column"),
                       ((F.count(c) > 0) & (F.sum(flag(~F.col(c).isin(0, 1))) == 0)).alias("binary")) for c in names]
    return df.agg(F.array(*checks).alias("c")).select(F.inline("c")).where("binary").select("column")


def imputation_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): 0 for flags and counts, else the median of the finite values."""
    zero = [c for c in columns if c in BINARY_COLUMNS or is_count(c)]
    rest = [c for c in columns if c not in zero]
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    if not rest:
        return names.select("column", F.lit(0.0).alias("value"))
    medians = quantiles_long(df.select(*[finite(F.col(c)).alias(c) for c in rest]), rest, [0.5])
    return names.join(medians.select(F.col("name").alias("column"), "value"), "column", "left").fillna(0.0, ["value"])


def apply_imputation(df: DataFrame, values: DataFrame) -> DataFrame:
    """Fill missing and non-finite numbers. ``values`` has one row per column."""
    fill = {r["column"]: r["value"] for r in values.collect()}
    return df.select(*[F.coalesce(finite(F.col(c)), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
                       for c in df.columns])


def dataset_report(df: DataFrame) -> DataFrame:
    """One row: shape, unique people, duplicate pairs, missing values, mixed labels, class balance, splits."""
    checked = [c for c in df.columns if c not in ("start_date", "event_time")]
    missing = sum((F.sum(flag(F.col(c).isNull())) for c in checked), F.lit(0))
    total = df.agg(
        F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.countDistinct("mentee_id").alias("unique_mentees"), F.countDistinct("mentor_id").alias("unique_mentors"),
        missing.alias("missing_values"), F.sum("label").alias("positives"),
        *[F.sum(flag(F.col("time_split") == s)).alias(f"{s}_rows") for s in ("train", "valid", "test")])
    per_pair = df.groupBy("mentee_id", "mentor_id").agg(
        F.count("*").alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    pairs = per_pair.agg(F.struct(F.sum(F.col("_n") - 1).alias("duplicate_pairs"),
                                  F.sum(flag(F.col("_low") != F.col("_high"))).alias("mixed_pairs"))).scalar()
    ratio = F.round(F.when(F.col("rows") > 0, F.col("positives") / F.when(F.col("rows") > 0, F.col("rows"))).otherwise(0.0), 4)
    return total.select("*", ratio.alias("positive_ratio"), pairs.alias("_p")).select(
        *total.columns, "positive_ratio", "_p.duplicate_pairs", "_p.mixed_pairs")


def dataset_verdict(df: DataFrame) -> DataFrame:
    """The report plus the list of reasons against using the dataset, and the verdict."""
    r = dataset_report(df)

    def count_error(c: str, text: str) -> Column:
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))

    errors = F.array_compact(F.array(
        count_error("duplicate_pairs", "duplicate pairs"), count_error("missing_values", "missing values"),
        count_error("mixed_pairs", "pairs with conflicting labels"),
        F.when(F.col("positive_ratio") == 0, F.lit("no positive labels")),
        F.when(F.col("valid_rows") == 0, F.lit("empty validation split")),
        F.when(F.col("test_rows") == 0, F.lit("empty test split"))))
    return r.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row with a SHA-256 over schema and column statistics; row order does not matter."""
    df = materialize(df, "fingerprinted")  # statistics and quantiles are two passes
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    stats = [F.count("*").alias("rows")]
    for f in df.schema.fields:
        c = F.col(f.name)
        parts = [F.lit(f.dataType.simpleString()).alias("dtype"), F.sum(flag(c.isNull())).alias("nulls")]
        if f.name in numeric:
            x = finite(c)
            parts += [F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"),
                      F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("std")]
        stats.append(F.struct(*parts).alias(f.name))
    one = df.agg(F.struct(*stats).alias("stats"))
    if numeric:
        q = quantiles_long(df.select(*[finite(F.col(c)).alias(c) for c in numeric]), numeric, [0.1, 0.25, 0.5, 0.75, 0.9])
        listed = q.agg(F.array_sort(F.collect_list(F.struct("name", "prob", F.round("value", 6).alias("value"))))).scalar()
        one = one.select("stats", listed.alias("quantiles"))
    return one.select(F.sha2(F.to_json(F.struct(*one.columns)), 256).alias("fingerprint"))


def feature_manifest(columns: Sequence[str], scaled: Sequence[str], version: str) -> dict:
    """Feature groups, lineage, required and optional columns, signature."""
    import hashlib
    import json

    def lineage(c: str) -> str:
        if c in BINARY_COLUMNS:
            return "business_rule"
        if c == "cf_score":
            return "collaborative"
        return "popularity" if c in POPULARITY_COLUMNS else "pair"

    optional = [c for c in columns if c in ("cf_score", "cf_confidence", "days_until_deadline", "deadline_passed")]
    payload = {"feature_cols": list(columns), "scale_cols": list(scaled)}
    return {
        "preprocessing_version": version, **payload,
        "required_feature_cols": [c for c in columns if c not in optional], "optional_feature_cols": optional,
        "groups": {"binary": [c for c in columns if c in BINARY_COLUMNS],
                   "ratio": [c for c in columns if c in RATIO_COLUMNS],
                   "count": [c for c in columns if is_count(c)],
                   "popularity": [c for c in columns if c in POPULARITY_COLUMNS]},
        "lineage": {c: lineage(c) for c in columns},
        "signature": hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()}


def align_to_manifest(df: DataFrame, manifest: Mapping, strict: bool = True,
                      fill: Mapping[str, float] | None = None) -> DataFrame:
    """Feature columns in manifest order. Strict raises on any difference; soft fills optional columns."""
    wanted = list(manifest["feature_cols"])
    missing = [c for c in manifest.get("required_feature_cols", wanted) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}")
    extra = [c for c in df.columns if c not in set(wanted) | ID_COLUMNS | LABEL_COLUMNS]
    absent = [c for c in wanted if c not in df.columns]
    if strict and (extra or absent):
        raise ValueError(f"frame does not fit the manifest: unexpected {extra}, absent {absent}")
    keep = [c for c in df.columns if c in ID_COLUMNS | LABEL_COLUMNS]
    values = [F.col(c) if c in df.columns else F.lit(float((fill or {}).get(c, 0.0))).alias(c) for c in wanted]
    return df.select(*keep, *values)


def require_compatible(manifest: Mapping, version: str, scaled: Sequence[str] | None = None,
                       features: Sequence[str] | None = None) -> None:
    """Stop before scoring with artifacts that do not belong together."""
    if not manifest:
        raise ValueError("manifest is empty")
    if manifest.get("preprocessing_version") != version:
        raise ValueError(f"manifest version {manifest.get('preprocessing_version')} is not {version}")
    for name, found in (("scale_cols", scaled), ("feature_cols", features)):
        if found is not None and list(manifest.get(name, [])) != list(found):
            raise ValueError(f"{name} differ from the manifest")
