"""Run named queries beside their SQL twins in DuckDB and compare values.

Usage: python tests/harness.py [-d SF_DIR] [prefix ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canon(v)) for k, v in value.items()))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def kind(t: str) -> str:
    return t.replace("large_string", "string").replace("[us, tz=UTC]", "[us]")


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted((tuple(canon(v) for v in row) for row in zip(*cols)), key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    mine = spark_df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    problems = []
    a, left = rows_of(mine)
    b, right = rows_of(theirs)
    if a != b:
        return [f"columns {a} vs {b}"]
    for n in a:
        x, y = kind(str(mine.schema.field(n).type)), kind(str(theirs.schema.field(n).type))
        if x != y:
            problems.append(f"type {n}: {x} vs {y}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        lset, rset = set(map(repr, left)), set(map(repr, right))
        problems.append(f"values: only ours {sorted(lset - rset)[:3]} only sql {sorted(rset - lset)[:3]}")
    if not left:
        problems.append("EMPTY")
    return problems


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    from lexweave.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name == p or name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                mode = "sql"
            else:
                n = len(df.toArrow())
                problems, mode = ([] if n else ["EMPTY"]), f"rows={n}"
        except Exception as exc:  # report and go on
            problems, mode = [str(exc)[:1500]], "error"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {time.time() - t:5.1f}s {mode:9s} {name} {' | '.join(problems)}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
