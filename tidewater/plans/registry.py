"""Registration of catalogue queries and the SQL that must give the same answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _zoneless(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock time, the form the SQL side returns them in."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is left out where plain SQL cannot state the operator."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _zoneless(function(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
