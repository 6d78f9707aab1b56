"""Compare registered queries with their SQL answers, order-insensitively.

    python tests/oracle_check.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> accepted DuckDB types
KINDS = {
    "string": {"VARCHAR"},
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "date": {"DATE"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if equal, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    answer = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    kinds = {c[0]: str(c[1]) for c in answer.description}
    want = answer.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    wrong = [(c, k, kinds[c]) for c, k in df.dtypes if kinds[c] not in KINDS.get(k, {k})]
    if wrong:
        return f"types {wrong}"
    left, right = _canon(df.columns, got), _canon(columns, want)
    if left != right:
        extra = [r for r in left if r not in set(right)][:2]
        missing = [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}; only Spark {extra}; only SQL {missing}"
    return None


def main() -> None:
    from tracklight.session import build

    zone = os.environ.get("CHECK_TIME_ZONE", "UTC")
    spark = build(
        "oracle-check",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__sql__session__timeZone=zone,
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    bad = 0
    for name in names or contract.queries():
        if name not in contract.oracle_sql():
            print(f"{name:32s} no SQL answer")
            continue
        start = time.time()
        try:
            difference = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        bad += difference is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {difference or 'equal'}"[:1200], flush=True)
    print(f"{bad} differences")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
