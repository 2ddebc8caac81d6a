"""Runs registered queries next to their SQL and compares whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r))
    )


def differences(spark, con, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    df = query(spark, sf_dir)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_columns, want = _rows(rel.columns, rel.fetchall())
    if got_columns != want_columns:
        return len(got), [f"columns {got_columns} against {want_columns}"]
    out = []
    if len(got) != len(want):
        out.append(f"{len(got)} rows against {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first:")
        for i, c in enumerate(got_columns):
            if bad[0][0][i] != bad[0][1][i]:
                a, b = str(bad[0][0][i]), str(bad[0][1][i])
                at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                out.append(f"  {c}: ...{a[max(0, at - 40):at + 60]!r} against ...{b[max(0, at - 40):at + 60]!r}")
    return len(got), out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            n, problems = differences(spark, con, queries[name], sql[name], sf_dir)
        except Exception as e:
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{bad} of {len(names or queries)} differ; without SQL: {sorted(queries.keys() - sql.keys())}")
