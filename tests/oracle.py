"""Side-by-side comparison of a Spark result with its SQL oracle."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Spark and DuckDB names of the same type.
_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _sorted_rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((value is None, str(value)) for value in row))


def differences(df, con, sql: str) -> list[str]:
    """What differs between the two results; empty when nothing does."""
    found = []
    rows = [tuple(row) for row in df.collect()]
    relation = con.sql(sql)
    expected = relation.fetchall()
    spark_types = {name: _TYPES.get(kind, kind) for name, kind in df.dtypes}
    oracle_types = dict(zip(relation.columns, map(str, relation.types)))
    if spark_types != oracle_types:
        found.append(f"schema {spark_types} != {oracle_types}")
        if set(spark_types) != set(oracle_types):
            return found
    if len(rows) != len(expected):
        found.append(f"{len(rows)} rows != {len(expected)}")
    a, b = _sorted_rows(rows, df.columns), _sorted_rows(expected, relation.columns)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        found.append(f"{len(wrong)} rows differ, first {wrong[:1]}")
    if not rows:
        found.append("no rows")
    return found
