"""Compare a query with its SQL check, value by value."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(out, key=lambda r: tuple(map(repr, r)))


def differences(spark, con, sf_dir, query, sql, show=3):
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:show]
        lost = [r for r in want if r not in set(got)][:show]
        return f"{len(got)} rows, expected {len(want)}; extra {extra}, missing {lost}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{names}: {len(bad)} of {len(got)} rows differ: {bad[:show]}"
    if not got:
        return "no rows"
    return None
