"""Runs a registered query on Spark and its SQL on DuckDB, and compares names, types and values."""
from __future__ import annotations

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, float) else round(v, 6)) if not isinstance(v, (list, dict)) else (True, "l", str(v)) for v in row)


def problems(df, con, sql):
    """Differences between a DataFrame and SQL, as text; empty when equal."""
    got_names = sorted(df.columns)
    rel = con.sql(sql)
    want_names = sorted(rel.columns)
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    types = dict(df.dtypes)
    out = []
    for n, dt in zip(rel.columns, rel.types):
        want = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
                "DATE": "date"}.get(str(dt), f"({dt})")
        if types[n] != want:
            out.append(f"type of {n}: {types[n]} != {want}")
    got = sorted((tuple(r[n] for n in got_names) for r in df.collect()), key=_key)
    idx = [rel.columns.index(n) for n in got_names]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=_key)
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} rows differ ({got_names}), first {bad[:2]}")
    if not got:
        out.append("note: empty result")
    return out
