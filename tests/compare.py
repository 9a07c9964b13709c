"""Compare Spark rows with oracle rows, whatever their order."""

from __future__ import annotations

from contextlib import redirect_stdout
from io import StringIO
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(r[i] for i in order) for r in rows),
        key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r),
    )


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    table = df.toArrow()
    rows = list(zip(*(c.to_pylist() for c in table.columns))) if table.num_rows else []
    return sorted(df.columns), _sorted(df.columns, rows)


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _sorted(columns, cursor.fetchall())


def formatted_plan(df: DataFrame) -> str:
    """The plan with its full, unabbreviated scan details."""
    text = StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()
