"""Side-by-side check of the named queries against DuckDB: ``python tests/compare.py [names…]``.

The folder is taken from COMPARE_DIR (default: sf0.01).
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(repr(row[i]) for i in order) for row in rows
    )


def difference(spark, con, query, sql, folder) -> str | None:
    """None when equal, else a short description."""
    start = time.time()
    frame = query(spark, folder)
    got = normal([tuple(r) for r in frame.collect()], frame.columns)
    print(f"{time.time() - start:6.2f}s", end=" ")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = normal(result.fetchall(), columns)
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    only_got = sorted(set(got[1]) - set(want[1]))[:2]
    only_want = sorted(set(want[1]) - set(got[1]))[:2]
    short = lambda rows: [tuple(v[:160] for v in row) for row in rows]
    return f"rows {len(got[1])} / {len(want[1])}; spark {short(only_got)}; duckdb {short(only_want)}"


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from pressroom.session import build_session

    folder = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, queries[name], oracles[name], folder)
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"ok (rows only: {len(queries[name](spark, folder).collect())})"
        except Exception as error:  # report and go on with the next query
            status = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not status.startswith("ok")
        print(f"{name:32} {time.time() - start:6.2f}s  {status}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
