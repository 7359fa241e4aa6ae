"""Compare registered queries with their SQL on the driver tables.

python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, q, sf):
    """None when equal, else a message."""
    df = q.build(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return None if got else "no rows", len(got)
    cur = con.execute(q.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {got[:1]} / {want[:1]}", len(got)
    if not got:
        return "no rows", 0
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
        return f"{len(bad)} rows differ, e.g. {g[:3]} {diff[:6]}", len(got)
    dead = [c for i, c in enumerate(got_cols) if all(r[i] is None for r in got)]
    if dead:
        return f"all null: {dead}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry  # noqa: F401
    from freshet.plans import load

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, q in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            msg, n = compare(spark, con, q, sf)
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name:34s} {n:7d} rows {time.time() - t:6.2f}s {'' if q.sql else '(rows only) '}{msg or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
