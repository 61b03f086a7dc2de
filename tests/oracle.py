"""Compare a query with its DuckDB oracle: columns by name, rows as a multiset."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def expected(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        at = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{at}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def compare(df, sql: str, sf_dir: str = SF) -> int:
    """Raise where the rows differ; the number of rows."""
    names, rows = expected(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    names_in_order = sorted(names)
    want = Counter(tuple(plain(r[names.index(n)]) for n in names_in_order) for r in rows)
    got = Counter(tuple(plain(r[n]) for n in names_in_order) for r in df.collect())
    assert got == want, f"{names_in_order}\nonly Spark: {list((got - want).items())[:4]} ({sum((got - want).values())})\nonly SQL: {list((want - got).items())[:4]} ({sum((want - got).values())})"
    return sum(got.values())
