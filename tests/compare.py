"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def difference(spark, con, folder, query, sql) -> str | None:
    """What differs between the two results, or nothing."""
    frame = query(spark, folder)
    got_names = sorted(frame.columns)
    got = [tuple(_plain(r[n]) for n in got_names) for r in frame.collect()]
    result = con.sql(sql)
    if sorted(result.columns) != got_names:
        return f"columns {got_names} != {sorted(result.columns)}"
    at = [result.columns.index(n) for n in got_names]
    want = [tuple(_plain(r[i]) for i in at) for r in result.fetchall()]
    if len(got) != len(want):
        extra = set(got) - set(want)
        short = set(want) - set(got)
        return f"{len(got)} rows != {len(want)}; {str(list(extra)[:2])[:800]} | {str(list(short)[:2])[:800]}"
    got.sort(key=_key)
    want.sort(key=_key)
    for a, b in zip(got, want):
        if a != b:
            return f"{got_names}\n  {str(a)[:1500]}\n  {str(b)[:1500]}"
        if [type(v) for v in a] != [type(v) for v in b]:
            return f"types {[type(v) for v in a]} != {[type(v) for v in b]}"
    return None


if __name__ == "__main__":
    import sys

    import __spark_entry__ as contract
    from citewright.session import local_session

    folder = sys.argv[1]
    session, con = local_session(8), connect(folder)
    queries, statements = contract.queries(), contract.oracle_sql()
    for name in sys.argv[2:] or queries:
        if name not in statements:
            print(f"{name:30s} no SQL", flush=True)
            continue
        began = time.time()
        try:
            found = difference(session, con, folder, queries[name], statements[name])
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__} {str(error)[:700]}"
        print(f"{name:30s} {'same' if found is None else found} {time.time() - began:.1f}", flush=True)
