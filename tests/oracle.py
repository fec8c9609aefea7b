"""Run a query in Spark and its SQL in DuckDB over the same tables and compare the rows."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return "null" if v is None else str(v)


def compare(spark, query, sql, sf_dir):
    """None if equal, else a description of the first differences."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(_plain(r.asDict(recursive=True)[c]) for c in names) for r in df.collect())
    table = connect(sf_dir).execute(sql).to_arrow_table()
    if sorted(table.column_names) != names:
        return f"columns {names} and {sorted(table.column_names)}"
    theirs = sorted(tuple(_plain(r[c]) for c in names) for r in table.to_pylist())
    if ours == theirs:
        return None
    diff = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:2]
    return f"{len(ours)} and {len(theirs)} rows; {str(diff)[:1500]}"
