"""Run registered queries next to their SQL in DuckDB and compare whole results.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def normalise(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty string if equal, else the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in sorted(got.columns):
        # A nullable integer arrives as float from one side and as an extension type from the other.
        nullable = str(want[c].dtype).startswith("Int") and got[c].dtype.kind == "f"
        if got[c].dtype.kind != want[c].dtype.kind and not nullable and not {got[c].dtype.kind, want[c].dtype.kind} <= {"O", "b", "U", "T"}:
            return f"dtype of {c}: {got[c].dtype} != {want[c].dtype}"
    for a, b in zip(normalise(got), normalise(want)):
        if a != b:
            return f"row {a} != {b}"
    return ""


def main() -> int:
    from ordscope.session import get_spark
    from ordscope.workloads import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in [n for q in names for n in QUERIES if n == q or (q.endswith("*") and n.startswith(q[:-1]))]:
        t = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - t
        note = "no sql"
        if name in ORACLES:
            try:
                note = compare(got, con.execute(ORACLES[name]).df())
            except Exception as exc:  # noqa: BLE001
                note = f"duckdb {type(exc).__name__}: {str(exc)[:600]}"
        ok = note in ("", "no sql")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={len(got)} {took:.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
