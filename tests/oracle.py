"""Comparison of a query's rows with those of its SQL in DuckDB."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _kind(dtype):
    text = str(dtype).lower()
    for names, kind in (
        (("bigint", "long", "hugeint"), "bigint"),
        (("integer", "int"), "int"),
        (("double",), "double"),
        (("boolean", "bool"), "boolean"),
        (("varchar", "string"), "string"),
        (("timestamp",), "timestamp"),
    ):
        if text.startswith(names):
            return kind
    return text


def rows_of_spark(df):
    names = sorted(df.columns)
    kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, kinds, rows


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    columns = [(d[0], _kind(d[1])) for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [columns[i][0] for i in order], dict(columns), rows


def differences(df, con, sql, show=3):
    """Texts that tell how the two results differ; empty when they agree."""
    names, kinds, ours = rows_of_spark(df)
    expected_names, expected_kinds, expected = rows_of_sql(con, sql)
    if names != expected_names:
        return [f"columns {names} != {expected_names}"]
    found = [f"type of {n}: {kinds[n]} != {expected_kinds[n]}" for n in names if kinds[n] != expected_kinds[n]]
    if len(ours) != len(expected):
        found.append(f"{len(ours)} rows != {len(expected)}")
    key = repr
    ours, expected = sorted(ours, key=key), sorted(expected, key=key)
    if ours != expected:
        left, right = set(map(key, ours)), set(map(key, expected))
        found += [f"only ours: {r[:400]}" for r in sorted(left - right)[:show]]
        found += [f"only SQL: {r[:400]}" for r in sorted(right - left)[:show]]
    return found
