"""Compare queries with their SQL as a driver would: columns by name, values without order."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd


def rows(frame):
    cols = sorted(frame.columns)
    out = []
    for r in frame[cols].itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NA or x != x else round(x, 6) if isinstance(x, float) else str(x) for x in (v if not hasattr(v, "tolist") else str(v.tolist()) for v in r)))
    return sorted(out, key=str)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    a, b = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    return a, b


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from notewright import session

    spark = session.build()
    spark.sparkContext.setLogLevel("ERROR")
    d = __import__("os").environ.get("COMPARE_DIR", "/root/testdata/sf0.01")
    con = connect(d)
    names = sys.argv[1:] or list(entry.oracle_sql())
    for n in names:
        t = time.time()
        try:
            a, b = compare(spark, con, n, entry.queries()[n], entry.oracle_sql()[n], d)
            print("ok  " if a == b else "DIFF", n, len(a), len(b), round(time.time() - t, 1), flush=True)
            if a != b:
                sa, sb = set(a), set(b)
                print("   spark only", list(sa - sb)[:2], "\n   sql only", list(sb - sa)[:2])
        except Exception as e:
            print("FAIL", n, str(e)[:600], flush=True)
