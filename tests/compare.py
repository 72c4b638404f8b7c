"""Run registered queries next to their SQL in DuckDB and compare by value.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DEFAULT_SF = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    """Rows as sorted tuples of text, columns in name order."""

    def text(value: object) -> str:
        if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float):
            return repr(value)
        if hasattr(value, "item") and not isinstance(value, (str, bytes)):
            return text(value.item()) if getattr(value, "size", 1) == 1 and getattr(value, "ndim", 0) == 0 else str(list(value))
        return str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in ordered.astype(object).itertuples(index=False, name=None))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    kinds = {c: (spark_frame[c].dtype.kind, sql_frame[c].dtype.kind) for c in spark_frame.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and len(spark_frame) and not spark_frame[c].isna().any()}
    if odd:
        return f"types {odd}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    only_left, only_right = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    if left != right:
        shown = "".join(f"\n   spark {a}" for a in only_left[:3]) + "".join(f"\n   sql   {b}" for b in only_right[:3])
        return f"{len(only_left)} of {len(left)} rows differ, columns {sorted(spark_frame.columns)}:{shown}"
    return None


def main() -> int:
    from palisade.plans import oracles, queries
    from palisade.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default=DEFAULT_SF)
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"))
    spark.sparkContext.setLogLevel("ERROR")
    known, sql = queries(), oracles()
    chosen = [n for n in known if not arguments.names or any(n.startswith(a) for a in arguments.names)]
    connection = connect(arguments.sf)
    failed = []
    for name in chosen:
        started = time.time()
        try:
            frame = known[name](spark, arguments.sf).toPandas()
            problem = differences(frame, connection.execute(sql[name]).df()) if name in sql else None
        except Exception as error:  # noqa: BLE001
            frame, problem = pd.DataFrame(), f"{type(error).__name__}: {str(error)[:1500]}"
        state = "FAIL" if problem else "ok  " if name in sql else "rows"
        print(f"{state} {name:34} {len(frame):7} rows {time.time() - started:6.2f}s", flush=True)
        if problem:
            failed.append(name)
            print("   " + problem, flush=True)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} good; {len([n for n in chosen if n in sql])} with SQL; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
