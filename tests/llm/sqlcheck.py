"""Compares a Spark result with DuckDB's for the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir, **paths):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{paths.get(t, f'{sf_dir}/{t}.parquet')}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def same(df, sql, sf_dir, **paths):
    names, want = oracle(sql, sf_dir, **paths)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[c] for c in sorted(names)) for r in df.collect()]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in want]
    rank = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    got, want = rank(got), rank(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
