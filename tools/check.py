"""Compare the registered queries with their SQL: python tools/check.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from headway.registry import ORACLES, QUERIES  # noqa: E402
from headway.session import local_session  # noqa: E402


def tables(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return None if mine else "no rows"
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    a, b = canonical(df.columns, mine), canonical(columns, theirs)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} / {len(b)}; only Spark {only_a}; only SQL {only_b}"


def types_differ(spark, connection, sf_dir: str, name: str) -> str | None:
    df = QUERIES[name](spark, sf_dir)
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}
    mine = {f.name: names.get(f.dataType.simpleString(), "?") for f in df.schema.fields}
    described = connection.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    theirs = {r[0]: str(r[1]) for r in described}
    wrong = {c: (mine.get(c), theirs.get(c)) for c in {*mine, *theirs} if mine.get(c) != theirs.get(c)}
    return str(wrong) if wrong else None


def main() -> None:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection, bad = local_session(8, "12g"), tables(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
            types = types_differ(spark, connection, sf_dir, name) \
                if name in ORACLES and not name.startswith("stream") else None
        except Exception as error:  # report and go on with the next query
            problem, types = "".join(traceback.format_exception_only(error))[:1500], None
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s"
              f"{'' if problem is None else ' ' + problem}{' types ' + types if types else ''}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
