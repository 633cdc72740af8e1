"""Small literal tables, given once and used by a query and by its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


#: Types of Spark's and DuckDB's DDL.
DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


class Inline:
    """``columns``: name -> type; ``rows``: tuples of plain values."""

    def __init__(self, columns: dict[str, str], rows: list[tuple]):
        self.columns, self.rows = columns, rows

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], ", ".join(f"{n} {t}" for n, t in self.columns.items()))

    @property
    def sql(self) -> str:
        """A parenthesised SELECT."""
        names = ", ".join(self.columns)
        casts = ", ".join(f"CAST({n} AS {DUCK[t]}) AS {n}" for n, t in self.columns.items())
        return f"(SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in self.rows)}) AS t({names}))"


class Grown(Inline):
    """Literal rows, and rows of the same columns made from a table: ``more(spark, sf_dir)``, and ``more_sql``, the SELECT that makes the same."""

    def __init__(self, columns: dict[str, str], rows: list[tuple], more: Callable[[SparkSession, str], DataFrame], more_sql: str):
        super().__init__(columns, rows)
        self.more, self.more_sql = more, more_sql

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return super().df(spark).unionByName(self.more(spark, sf_dir))

    @property
    def sql(self) -> str:
        return f"(SELECT * FROM {super().sql} UNION ALL BY NAME {self.more_sql})"


class Extended(Inline):
    """Literal rows, and those that one SELECT makes from a table: text that Spark and DuckDB read alike."""

    def __init__(self, source: str, select: str, columns: dict[str, str], rows: list[tuple]):
        super().__init__(columns, rows)
        self.source, self.select = source, select

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        made = spark.sql(self.select.replace(f"FROM {self.source}", "FROM {made_from}"), made_from=table(spark, sf_dir, self.source))
        return super().df(spark).unionByName(made.select(*[made[c].cast(t) for c, t in self.columns.items()]))

    @property
    def sql(self) -> str:
        casts = ", ".join(f"CAST({n} AS {DUCK[t]}) AS {n}" for n, t in self.columns.items())
        return f"(SELECT * FROM {super().sql} UNION ALL BY NAME SELECT {casts} FROM ({self.select}))"
