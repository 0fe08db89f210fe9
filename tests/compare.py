"""Run registered queries next to their DuckDB SQL and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    return value


def rows(records, columns) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_plain(r[i]) for i in order) for r in records]
    return names, sorted(out, key=repr)


def compare(spark, con, query, sql, sf_dir):
    """(error or None, number of rows, Spark types, DuckDB types)."""
    df = query(spark, sf_dir)
    got_names, got = rows([tuple(r) for r in df.collect()], df.columns)
    relation = con.sql(sql)
    want_names, want = rows(relation.fetchall(), relation.columns)
    spark_types = dict(df.dtypes)
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got), spark_types, duck_types
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got), spark_types, duck_types
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    error = f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"[:1500] if bad else None
    return error, len(got), spark_types, duck_types


MATCHING = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def main(argv) -> int:
    import __spark_entry__ as entry
    from reviewloom.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark, con = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                error, n, st, dt = compare(spark, con, queries[name], oracles[name], sf_dir)
                odd = {c: (st[c], dt.get(c)) for c in st if MATCHING.get(st[c], dt.get(c)) != dt.get(c)}
                note = f" types {odd}" if odd else ""
            else:
                error, n, note = None, queries[name](spark, sf_dir).count(), " (rows only)"
        except Exception as exc:  # report and go on with the next query
            error, n, note = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, ""
        failed += error is not None
        print(f"{'FAIL' if error else 'ok  '} {name:28s} {n:8d} rows {time.time() - start:6.2f}s{note}"
              + (f"\n     {error}" if error else ""), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv)))
