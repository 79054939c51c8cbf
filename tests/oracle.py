"""Runs registered queries and their SQL counterparts, and compares the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


CLASSES = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "int",
    "FLOAT": "float", "DOUBLE": "float",
}


def kinds(connection, relation: str) -> dict[str, str]:
    rows = connection.execute(f"DESCRIBE {relation}").fetchall()
    return {r[0]: CLASSES.get(r[1], r[1].split("(")[0]) for r in rows}


def compare(spark, connection, name, query, sql, folder):
    """None when both give the same bag of rows, else a description of the difference."""
    frame = query(spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoopJoin"):
        if bad in plan:
            return f"the plan compares all pairs: {bad}"
    connection.register("ours", frame.toArrow())
    connection.execute(f"CREATE OR REPLACE TEMP TABLE theirs AS {sql}")
    mine, other = kinds(connection, "ours"), kinds(connection, "theirs")
    if mine != other:
        return f"columns {mine} != {other}"
    # As text, so that even the sign of a zero has to agree.
    columns = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in sorted(mine))

    def extra(a: str, b: str) -> list:
        return connection.execute(
            f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3"
        ).fetchall()

    counts = [
        connection.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("ours", "theirs")
    ]
    only_ours, only_theirs = extra("ours", "theirs"), extra("theirs", "ours")
    connection.unregister("ours")
    if counts[0] != counts[1]:
        return f"{counts[0]} rows, oracle has {counts[1]}: {only_ours} / {only_theirs}"
    if only_ours or only_theirs:
        return f"rows differ, e.g. {only_ours} / {only_theirs}"
    return None


def main(folder: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from tidewrack.session import local_session

    spark = local_session()
    connection = duck(folder)
    sql = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        started = time.time()
        try:
            if name in sql:
                problem = compare(spark, connection, name, query, sql[name], folder)
                rows = None
            else:
                rows = query(spark, folder).collect()
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {chr(32).join(str(error).split())[:420]}"
        bad += problem is not None
        note = problem or ("ok" if name in sql else f"rows only: {len(rows)}")
        print(f"{name:32} {time.time() - started:6.1f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
