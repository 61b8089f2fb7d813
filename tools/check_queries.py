"""Run registered queries next to their SQL on DuckDB and compare the results.

Usage: python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


# DuckDB types that each Spark type must meet
SAME_TYPES = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, float):
        return repr(v + 0.0) if v else "0.0"
    return str(v)


def compare(spark, con, name, build, sql, sf_dir):
    t = time.time()
    df = build(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t
    if sql is None:
        return True, f"rows only n={len(rows)}", took
    t = time.time()
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = dict(zip(names, [c[1] for c in rel.description]))
    want = rel.fetchall()
    sql_took = time.time() - t
    mine = dict(df.dtypes)
    if sorted(mine) != sorted(names):
        return False, f"columns {sorted(mine)} vs {sorted(names)}", took
    bad = {c: (mine[c], str(kinds[c])) for c in names if SAME_TYPES.get(mine[c]) != str(kinds[c])}
    order = sorted(names)
    a = sorted(tuple(cell(r[c]) for c in order) for r in rows)
    at = [names.index(c) for c in order]
    b = sorted(tuple(cell(r[i]) for i in at) for r in want)
    if bad:
        return False, f"types {bad}", took
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [x for x in a if x not in in_b][:2]
        only_b = [x for x in b if x not in in_a][:2]
        return False, f"rows {len(a)} vs {len(b)}; {order}; spark {only_a}; sql {only_b}", took
    return True, f"n={len(a)} sql={sql_took:.2f}s", took


def main(argv):
    import duckdb
    from antipode.plans import ORACLE, QUERIES
    from antipode.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = []
    for name in names:
        try:
            ok, text, took = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, text, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {took:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
