"""Compare a query's rows with its DuckDB SQL: columns by name, rows in any order, exact values.

`python -m tests.compare [scale-folder] [name ...]` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


# Spark type -> DuckDB types that hold the same values.
_SAME_TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "float": {"FLOAT"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp": {"TIMESTAMP"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    result = con.execute(sql)
    wanted_types = {d[0]: str(d[1]) for d in result.description}
    wanted = _rows([d[0] for d in result.description], result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != wanted[0]:
        return f"columns {got[0]} != {wanted[0]}"
    for name, type_name in df.dtypes:
        if wanted_types[name] not in _SAME_TYPES.get(type_name, {wanted_types[name]}):
            return f"type of {name}: {type_name} != {wanted_types[name]}"
    if got[1] != wanted[1]:
        extra, missing = got[1] - wanted[1], wanted[1] - got[1]
        return (
            f"rows {got[1].total()} / {wanted[1].total()}, {extra.total()} differ, "
            f"e.g. {[str(r)[:300] for r in list(extra)[:2]]} != {[str(r)[:300] for r in list(missing)[:2]]}"
        )
    return None


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scale_problem(df) -> str | None:
    """An all-pairs join, or a window over the whole table in one task.

    The one unpartitioned window allowed is over partition sizes (global rank and ntile).
    """
    text = plan(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in text:
            return bad
    for line in re.findall(r"Window \[.*", text):
        if re.search(r"AS \w+#\w+\], \[\w+#\w+ ", line) and "__size" not in line:
            return line
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, oracles = build_session(), connect(sf_dir), oracle_sql()
    unknown = set(oracles) - set(queries())
    if unknown:
        print("no query for", unknown)
    for name, query in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        started = time.time()
        try:
            if name in oracles:
                outcome = difference(query(spark, sf_dir), con, oracles[name]) or "equal"
            else:
                outcome = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:34s} {time.time() - started:6.1f}s  {outcome}", flush=True)


if __name__ == "__main__":
    main()
