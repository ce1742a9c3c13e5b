"""Side-by-side run of a query and its SQL, for tests and for the command line."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    """Row count, column names and values of both sides."""
    import duckdb

    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    out = {"name": name, "rows": len(got), "sec": round(time.time() - t, 2), "ok": None}
    if sql is None:
        return out
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    out["sql_sec"] = round(time.time() - t, 2)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    out["ok"] = sorted(df.columns) == sorted(cols) and a == b
    if not out["ok"]:
        diff = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        out["why"] = f"cols {sorted(df.columns)} / {sorted(cols)}; rows {len(a)} / {len(b)}; {diff}"
    return out


def main(argv: list[str]) -> int:
    """``python -m ticketloom.checks.compare <folder> [name prefix ...]``"""
    from ticketloom.checks import ORACLES, QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            r = compare(spark, argv[0], name, fn, ORACLES.get(name))
        except Exception as e:
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += r["ok"] is False
        print(r if r["ok"] is False else {k: v for k, v in r.items() if k != "why"}, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
