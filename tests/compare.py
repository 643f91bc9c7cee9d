"""A query's rows beside those of its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return None if v is None else str(v)


def both(spark, root, query, sql):
    con = duckdb.connect()
    for p in Path(root).iterdir():
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = query(spark, root)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    return ours, Counter(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())
