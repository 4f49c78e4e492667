"""Compares a registered query with its DuckDB SQL, row by row."""

import duckdb


def same(spark, name, sf_dir):
    from docweave.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(SQL[name])
    cols = sorted(d[0] for d in want.description)
    at = [next(i for i, d in enumerate(want.description) if d[0] == c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    df = QUERIES[name](spark, sf_dir)
    got = sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)
    assert sorted(df.columns) == cols
    assert got == want, next(((a, b) for a, b in zip(got, want) if a != b), (len(got), len(want)))
