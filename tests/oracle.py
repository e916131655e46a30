"""Compare registered queries with their SQL in DuckDB.

``python -m tests.oracle [sf] [name ...]`` checks the named queries (default: all).
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()

# DuckDB type -> Spark type, for the types the queries return.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    # As text, so that 0.0 and -0.0 count as different.
    return repr(v) if isinstance(v, float) else v


def bag(rows, order) -> Counter:
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[list[str], int]:
    """Differences (none if equal) and the row count."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names, kinds = list(rel.columns), [str(t) for t in rel.types]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"], 0
    spark_types = dict(df.dtypes)
    for name, kind in zip(names, kinds):
        if TYPES.get(kind) != spark_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} != {kind}")
    mine = bag(df.collect(), [df.columns.index(c) for c in sorted(names)])
    theirs = bag(rel.fetchall(), [names.index(c) for c in sorted(names)])
    if mine != theirs:
        only_mine, only_theirs = mine - theirs, theirs - mine
        problems.append(
            f"rows {sum(mine.values())} / {sum(theirs.values())}, only here {sum(only_mine.values())}"
            f" e.g. {sorted(map(str, only_mine))[:2]}, only there {sum(only_theirs.values())} e.g. {sorted(map(str, only_theirs))[:2]}"
        )
    return problems, sum(mine.values())


def main() -> int:
    from sigspark.registry import ORACLES, QUERIES
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problems, n = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                problems, n = [], QUERIES[name](spark, sf_dir).count()
        except Exception as error:  # report and go on with the next query
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], 0
        bad += bool(problems)
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'FAIL' if problems else 'ok':4} {name:24} {kind} {n:8} rows {time.time() - start:6.2f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
