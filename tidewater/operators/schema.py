"""Schema drift: what a delivery or a contract changes, decided over field rows.

Field rows are `(table_name, column_name, data_type)`, so one job compares the
schemas of many tables; `field_rows` makes them from a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.names import col, resolve
from tidewater.operators.conform import align_schema

DECIMAL = r"^decimal\((\d+),\s*(\d+)\)$"


class SchemaConflict(ValueError):
    """A delivery carries a type the table cannot take; nothing was written."""


def field_rows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(
        [(table, f.name, f.dataType.simpleString()) for f in schema.fields],
        "table_name string, column_name string, data_type string")


def widens(held: Column, incoming: Column) -> Column:
    """int to bigint, float to double, decimal to a longer one of the same scale."""
    held_p, held_s = (F.regexp_extract(held, DECIMAL, g).try_cast("int") for g in (1, 2))
    new_p, new_s = (F.regexp_extract(incoming, DECIMAL, g).try_cast("int") for g in (1, 2))
    longer = (held_s == new_s) & (new_p > held_p)
    return (((held == "int") & (incoming == "bigint"))
            | ((held == "float") & (incoming == "double"))
            | F.coalesce(longer, F.lit(False)))


def schema_drift(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every column of either side: same, added, missing, widened or conflict.

    Names are compared without case; all conflicts are reported at once.
    """
    side = lambda df, p: df.select(
        F.col("table_name"), F.lower("column_name").alias("column_key"),
        F.col("column_name").alias(f"{p}_name"), F.col("data_type").alias(f"{p}_type"))
    both = side(held, "held").join(
        side(incoming, "incoming"), ["table_name", "column_key"], "full_outer")
    change = (
        F.when(F.col("held_type").isNull(), "added")
        .when(F.col("incoming_type").isNull(), "missing")
        .when(F.col("held_type") == F.col("incoming_type"), "same")
        .when(widens(F.col("held_type"), F.col("incoming_type")), "widened")
        .otherwise("conflict"))
    text = F.concat(F.col("held_name"), F.lit(": table holds "), F.col("held_type"),
                    F.lit(", batch carries "), F.col("incoming_type"))
    return both.select(
        "table_name", F.coalesce("held_name", "incoming_name").alias("column_name"),
        "held_type", "incoming_type", change.alias("change"),
        F.when(change == "conflict", text).alias("conflict"))


def contract_check(published: DataFrame, current: DataFrame) -> DataFrame:
    """Which changes to a published contract need approval.

    Added columns and widened types are compatible (widening is reviewed); dropped or
    renamed columns and any other type change are breaking.
    """
    drift = schema_drift(published, current)
    verdict = (
        F.when(F.col("change").isin("missing", "conflict"), "breaking")
        .when(F.col("change") == "widened", "review")
        .otherwise("compatible"))
    return drift.groupBy("table_name").agg(
        F.count_if(verdict == "breaking").alias("breaking"),
        F.count_if(verdict == "review").alias("review"),
        F.count_if(F.col("change") == "added").alias("added"),
    ).withColumn("needs_approval", F.col("breaking") > 0)


def _promotable(held: T.DataType, incoming: T.DataType) -> bool:
    if held == incoming:
        return True
    if isinstance(held, T.DecimalType) and isinstance(incoming, T.DecimalType):
        return held.scale == incoming.scale and incoming.precision >= held.precision
    return (held.simpleString(), incoming.simpleString()) in {
        ("int", "bigint"), ("float", "double")}


def conflicts(held: T.StructType, incoming: T.StructType) -> list[str]:
    """Plan-time form of the drift report for one delivery: its conflict texts."""
    found = []
    for field in incoming.fields:
        name = resolve(held.fieldNames(), field.name)
        if name is not None and not _promotable(held[name].dataType, field.dataType):
            found.append(f"{name}: table holds {held[name].dataType.simpleString()}, "
                         f"batch carries {field.dataType.simpleString()}")
    return found


def refuse_conflicts(table: str, held: T.StructType, incoming: T.StructType) -> None:
    """Raise before any job runs, naming every column that cannot be reconciled."""
    found = conflicts(held, incoming)
    if found:
        raise SchemaConflict(f"delivery conflicts with the schema of {table}: " + "; ".join(found))


def merged_schema(held: T.StructType, incoming: T.StructType) -> T.StructType:
    """Held columns, widened where the delivery widens them, then the added ones.

    Declaring this schema on read is how older Parquet files show a later column as
    null and an int column as bigint; `mergeSchema` fails across widened types.
    """
    refuse_conflicts("table", held, incoming)
    fields = []
    for field in held.fields:
        name = resolve(incoming.fieldNames(), field.name)
        kind = incoming[name].dataType if name else field.dataType
        fields.append(T.StructField(field.name, kind, True))
    added = [T.StructField(f.name, f.dataType, True) for f in incoming.fields
             if resolve(held.fieldNames(), f.name) is None]
    return T.StructType(fields + added)


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Align to a merged schema and cast where it is wider."""
    aligned = align_schema(df, schema)
    return aligned.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
