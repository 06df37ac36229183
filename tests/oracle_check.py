"""Compare registered queries with their oracle SQL: `python -m tests.oracle_check [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(f"{value:.9g}") if abs(value) < 10**9 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return tuple(plain(v) for v in value.tolist())
    return str(value)


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = bag(names, result.fetchall())
    got = bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} vs {sorted(names)}")
    if got != expected:
        problems.append(f"rows {sum(got.values())} vs {sum(expected.values())}")
        for row in list((got - expected))[:3]:
            problems.append(f"  only spark {row}")
        for row in list((expected - got))[:3]:
            problems.append(f"  only sql   {row}")
    return problems


def main(argv: list[str]) -> int:
    from veritab.session import local_session

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = local_session(8)
    con = connect(SF)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = run(spark, SF)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                size = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
                note = f"{size} rows"
                if size == 0:
                    problems.append("empty result")
            else:
                problems, note = [], f"{df.count()} rows, no oracle"
        except Exception as error:  # noqa: BLE001
            problems, note = [str(error)[:1500]], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for line in problems:
            print("     ", line[:1500])
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
