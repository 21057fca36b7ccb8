"""Compare registered queries with their SQL on the driver's tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr), [columns[i] for i in order]


def difference(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when both sides agree, else a description of the first difference."""
    frame = fn(spark, sf_dir)
    got, columns = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    want, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if columns != expected:
        return f"columns {columns} != {expected}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y or type(x) is not type(y)]
            return f"first difference {bad[:4]} in {sum(p != q for p, q in zip(got, want))} of {len(got)} rows"
    return None


def main(names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from paircast.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = "/root/testdata/sf0.01"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or sorted(queries):
        begin = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, sf_dir, queries[name], oracles[name])
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
