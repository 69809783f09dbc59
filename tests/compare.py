"""Order-insensitive comparison of a Spark result with its DuckDB counterpart."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or isinstance(value, (bool, str, bytes)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    rel = con.sql(sql)
    return rows_of(rel.columns, rel.fetchall())


def difference(df, con, sql):
    """None when equal, else a short text."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if sr != dr:
        only_s, only_d = list((sr - dr).items())[:2], list((dr - sr).items())[:2]
        return f"rows {sum(sr.values())} vs {sum(dr.values())}\n  spark only: {only_s!r:.1500}\n  sql only: {only_d!r:.1500}"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from quire.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note = f"rows-only {df.count()}"
                problem = None
        except Exception as exc:  # report every query
            problem = note = f"ERROR {type(exc).__name__}: {str(exc)[:1200]}"
        bad += problem is not None
        print(f"{name}: {time.time() - t0:.1f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
