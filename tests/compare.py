"""Run registered queries next to their oracle SQL and compare values.

    python tests/compare.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from matchspark.fixtures import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{sf_dir}/{b}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name and values as text, sorted."""

    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, float):
            return repr(v + 0.0)
        if hasattr(v, "item"):
            return show(v.item())
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(show(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def family(dtype: str) -> str:
    d = str(dtype).lower()
    for name in ("float", "int", "bool", "datetime"):
        if name in d:
            return name
    return "text"


def difference(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} vs {len(duck_df)}"
    a, b = canon(spark_df), canon(duck_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    for c in spark_df.columns:
        x, y = family(spark_df[c].dtype), family(duck_df[c].dtype)
        if x != y and not spark_df[c].isna().any():
            return f"type of {c}: {spark_df[c].dtype} vs {duck_df[c].dtype}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    import __spark_entry__ as entry
    from matchspark.session import local_session
    quick = {} if os.environ.get("FULL_PLANS") else {
        "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    spark = local_session(cores="8", shuffle_partitions=2 if quick else 8, **quick)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = []
    from matchspark.checks.registry import QUERIES
    areas = {n: getattr(f, "area", "") for n, f in QUERIES.items()}
    for name, fn in entry.queries().items():
        if wanted and not any(w in name or w == areas.get(name) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
        except Exception as exc:
            failed.append(name)
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:1500]}")
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s")
            continue
        try:
            expected = con.execute(oracles[name]).df()
        except Exception as exc:
            failed.append(name)
            print(f"FAIL  {name}: oracle: {str(exc)[:1500]}")
            continue
        took_duck = time.time() - start - took
        problem = difference(got, expected)
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '}  {name}: {len(got)} rows, {took:.1f}s ({took_duck:.1f}s) {problem or ''}"[:1500])
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
