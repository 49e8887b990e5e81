"""Reading the table set from CSV folders or a database, with tolerant column names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from matchspark.functions.dates import parse_time
from matchspark.schemas import ADDITIVE, PROGRAM_TABLES, TABLES, Table, plain

EMPTY = ["", "nan", "NaN", "None"]
_SPOILT = "_spoilt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a file exists on whatever file system the path names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The delimiter of a text file, judged by its header line."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    return max([",", ";", "\t", "|"], key=line.count)


def read_text_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header, every column as text, empty text kept as empty."""
    df = (
        spark.read.option("header", True).option("sep", sep or ",").option("multiLine", True)
        .option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    )
    return df.toDF(*[c.strip() for c in df.columns])


def read_checked_table(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A delimited file as of ``read_text_table`` without its malformed records, and those: (file, record, reason).

    A record is malformed if it has fewer or more fields than the header. Nothing is dropped: every record is in one
    of the two frames.
    """
    sep = sep or sniff_separator(spark, path)
    folders = spark.read.text(path).columns[1:]  # columns that only the folders name
    names = [c for c in spark.read.option("header", True).option("sep", sep).csv(path).columns if c not in folders]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _SPOILT]])
    rows = (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
        .option("emptyValue", "").option("nullValue", "\u0000").option("mode", "PERMISSIVE").option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _SPOILT).csv(path)
        .select(*names, _SPOILT, F.col("_metadata.file_path").alias("_file"))
        # names every column, so that no reader of a few columns makes the scan skip what it must check
        .where(F.length(F.concat_ws("", *[F.col(f"`{n}`") for n in names])) >= 0)
    )
    fields = F.size(F.split(F.regexp_replace(_SPOILT, '"[^"]*"', ""), re.escape(sep)))
    bad = rows.where(F.col(_SPOILT).isNotNull()).select(
        F.col("_file").alias("file"), F.col(_SPOILT).alias("record"),
        F.when((fields < len(names)) & F.col(f"`{names[-1]}`").isNull(), "too few fields").when(fields > len(names), "too many fields").otherwise("unreadable").alias("reason"))
    good = rows.where(F.col(_SPOILT).isNull()).select(*names)
    return good.toDF(*[c.strip() for c in names]), bad


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Several files of one logical table; columns missing in one file become null."""
    out = frames[0]
    for extra in frames[1:]:
        out = out.unionByName(extra, allowMissingColumns=True)
    return out


def resolve(df: DataFrame, names: Iterable[str]) -> str | None:
    """The actual column matching one of ``names``, ignoring case and punctuation."""
    actual = {plain(c): c for c in reversed(df.columns)}
    for name in names:
        if plain(name) in actual:
            return actual[plain(name)]
    return None


def first_value(df: DataFrame, *names: str) -> Column:
    """The first of several columns that is present and not empty in a row."""
    present = [c for c in (resolve(df, [n]) for n in names) if c is not None]
    if not present:
        return F.lit(None).cast("string")
    kept = [F.when(~F.trim(F.col(c)).isin(*EMPTY), F.col(c)) for c in present]
    return F.coalesce(*kept)


def typed(c: Column, dtype: str) -> Column:
    if dtype == "timestamp":
        return parse_time(c)
    if dtype in ("bigint", "int"):
        return F.coalesce(c.try_cast(dtype), c.try_cast("double").try_cast(dtype))
    return c if dtype == "string" else c.try_cast(dtype)


def map_table(df: DataFrame, spec: Table, cast: bool = True) -> DataFrame:
    """Rename to the target schema; a column the source lacks becomes a typed null.

    Columns the schema does not know keep their name.
    """
    out, used = [], set()
    for target, dtype in spec.columns.items():
        found = resolve(df, spec.source_names(target))
        if found is None:
            out.append(F.lit(None).cast(dtype).alias(target))
            continue
        used.add(found)
        out.append((typed(F.col(found), dtype) if cast else F.col(found)).alias(target))
    rest = [F.col(c) for c in df.columns if c not in used and c not in spec.columns]
    return df.select(*out, *rest)


def lower_status(df: DataFrame) -> DataFrame:
    """Publication and availability labels in comparable form."""
    for c in ("is_open", "availability"):
        if c in df.columns:
            df = df.withColumn(c, F.lower(F.trim(F.col(c))))
    return df


def read_tables(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """All tables found in a folder of CSV exports. Missing critical tables raise."""
    out: dict[str, DataFrame] = {}
    missing = []
    for name in names or TABLES:
        spec = TABLES[name]
        found = [f"{folder}/{f}" for f in spec.files if path_exists(spark, f"{folder}/{f}")]
        if name not in ADDITIVE:
            found = found[:1]
        if not found:
            missing.append(name)
            continue
        mapped = map_table(union_frames([read_text_table(spark, p) for p in found]), spec)
        out[name] = lower_status(mapped) if name == "mentorship_posts" else mapped
    absent = [n for n in missing if TABLES[n].critical]
    if absent:
        raise FileNotFoundError(f"critical tables missing in {folder}: {sorted(absent)}")
    return out


def read_tables_checked(spark: SparkSession, folder: str, names: Iterable[str]) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The named tables of a folder as of ``read_tables``, and the malformed records of all their files.

    The second frame is (table, file, record, reason); None if no file was found.
    """
    out: dict[str, DataFrame] = {}
    rejected = None
    for name in names:
        spec = TABLES[name]
        found = [f"{folder}/{f}" for f in spec.files if path_exists(spark, f"{folder}/{f}")]
        if not found:
            if spec.critical:
                raise FileNotFoundError(f"critical table missing in {folder}: {name}")
            continue
        pairs = [read_checked_table(spark, p) for p in (found if name in ADDITIVE else found[:1])]
        mapped = map_table(union_frames([good for good, _ in pairs]), spec)
        out[name] = lower_status(mapped) if name == "mentorship_posts" else mapped
        for _, bad in pairs:
            named = bad.select(F.lit(name).alias("table"), "file", "record", "reason")
            rejected = named if rejected is None else rejected.union(named)
    return out, rejected


def read_program_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The shorter table list of the program side."""
    return read_tables(spark, folder, PROGRAM_TABLES)


def read_database(spark: SparkSession, url: str, tables: dict[str, str], partition: dict[str, tuple] | None = None,
                  **options: str) -> dict[str, DataFrame]:
    """Tables over JDBC with the same schema mapping.

    ``tables`` maps a logical name to a database table. ``partition`` may give
    ``(column, lower, upper, parts)`` per logical name so that large tables are read in parallel.
    """
    out = {}
    for name, dbtable in tables.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
        if partition and name in partition:
            column, lower, upper, parts = partition[name]
            reader = (reader.option("partitionColumn", column).option("lowerBound", lower)
                      .option("upperBound", upper).option("numPartitions", parts))
        mapped = map_table(reader.load(), TABLES[name])
        out[name] = lower_status(mapped) if name == "mentorship_posts" else mapped
    absent = [n for n, t in TABLES.items() if t.critical and n not in out]
    if absent:
        raise RuntimeError(f"critical tables missing in the database: {sorted(absent)}")
    return out
