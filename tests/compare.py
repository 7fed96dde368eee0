"""Run registered queries next to their SQL text and compare whole results.

Usage: python -m tests.compare <sf folder> [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def normalise(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [names[i] for i in order], out


def differences(spark_df, con, sql):
    """None when equal, else a short description."""
    names, rows = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    o_names, o_rows = normalise([c[0] for c in cur.description], cur.fetchall())
    if names != o_names:
        return f"columns {names} vs {o_names}"
    if len(rows) != len(o_rows):
        return f"rows {len(rows)} vs {len(o_rows)}"
    bad = [(a, b) for a, b in zip(rows, o_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    if not rows:
        return "no rows"
    return None


def main(argv):
    from wattlens.session import build_session, owned_stages, ship_package

    from wattlens.plans.catalog import ORACLES, QUERIES

    folder, picks = argv[0], argv[1:]
    spark = build_session(
        "compare", os.environ.get("COMPARE_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    con = connect(folder)
    failed = 0
    for name, fn in QUERIES.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t0 = time.time()
        try:
            with owned_stages(spark):
                df = fn(spark, folder)
                if name in ORACLES:
                    problem = differences(df, con, ORACLES[name])
                else:
                    problem = None if df.collect() else "no rows"
        except Exception as e:  # noqa: BLE001 - a report, not a handler
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {time.time() - t0:6.2f}s {'' if name in ORACLES else '(rows) '}{name} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
