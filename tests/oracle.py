"""Compares a Spark result with the result of its SQL in DuckDB. Also a command:

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    return "float" if isinstance(v, (float, decimal.Decimal)) else type(v).__name__


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty if both results are the same."""
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    sql_names, want = _rows([c[0] for c in cur.description], cur.fetchall())
    if names != sql_names:
        return [f"columns {names} != {sql_names}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}", f"first {got[:2]} / {want[:2]}"]
    found = [f"{a} != {b}" for a, b in zip(got, want) if a != b]
    for i, n in enumerate(names):
        a = {_kind(r[i]) for r in got if r[i] is not None}
        b = {_kind(r[i]) for r in want if r[i] is not None}
        if a != b:
            found.append(f"type of {n}: {a} != {b}")
    return found


def main(sf_dir: str, chosen: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from riskloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if chosen and not any(c in name for c in chosen):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                found = compare(df, con, sqls[name])
                verdict = "ok" if not found else "DIFF"
            else:
                found, verdict = [], f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            found, verdict = [f"{type(error).__name__}: {str(error)[:1500]}"], "ERROR"
        failed += bool(found)
        print(f"{name:32s} {verdict:8s} {time.time() - start:6.2f}s", flush=True)
        for line in found[:4]:
            print("     ", line[:1500], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
