"""Compare a query with its SQL: python tests/compare.py [sf_dir] [names...]."""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.item() if hasattr(v, "item") else v


def difference(spark, sf_dir, query, sql) -> str | None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted([tuple(normal(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()], key=str)
    cur = con.execute(sql)
    at = [d[0] for d in cur.description]
    if sorted(at) != names:
        return f"columns {names} and {sorted(at)}"
    theirs = sorted([tuple(normal(r[at.index(n)]) for n in names) for r in cur.fetchall()], key=str)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, as {names}: {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from bidloom.session import local_session

    spark = local_session("compare", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            found = difference(spark, sf_dir, queries[name], oracles[name]) if name in oracles else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:
            found = f"failed: {str(e)[:600]}"
        print(f"{name}: {found or 'same'} ({time.time() - began:.1f} s)", flush=True)
