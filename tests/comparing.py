"""Running a query and its SQL counterpart over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def as_bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def differences(frame, connection, sql: str) -> list[str]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected_rows = result.fetchall()
    found = []
    if sorted(columns) != sorted(frame.columns):
        found.append(f"columns {sorted(frame.columns)} != {sorted(columns)}")
        return found
    for name, kind in frame.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    got = as_bag(frame.columns, frame.collect())
    expected = as_bag(columns, expected_rows)
    if got != expected:
        found.append(f"{sum(got.values())} rows vs {sum(expected.values())}; "
                     f"only here {str(list((got - expected).items())[:2])[:700]}; "
                     f"only in SQL {str(list((expected - got).items())[:2])[:700]}")
    return found
