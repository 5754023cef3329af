"""Landing files: one delivery each, read by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.names import col
from tidewater.operators.conform import type_check

CORRUPT = "_corrupt_record"


def _format(path: str) -> str:
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return "csv"
    if lower.endswith((".json", ".ndjson")):
        return "json"
    raise ValueError(f"landing file must end in .csv, .json or .ndjson: {path}")


def read_landing(spark: SparkSession, path: str,
                 schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header, JSON or NDJSON; the extension decides, never the content.

    A declared schema is preferred: inference costs a pass over the file, and types drift
    with the values. Text that does not fit a declared type reads as null; use
    `read_landing_checked` to keep such rows.
    """
    kind, reader = _format(path), spark.read
    if kind == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    return reader.format(kind).load(path)


def read_landing_checked(spark: SparkSession, path: str,
                         schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the declared types, rows that do not fit).

    Values are read as text and cast here, so a bad one is found whichever columns a
    query later selects. Rejected rows keep their text, the names of the columns that do
    not fit, and the whole line where it could not be split into columns at all.
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    nested = (T.StructType, T.ArrayType, T.MapType)
    as_text = [
        f if isinstance(f.dataType, nested) else T.StructField(f.name, T.StringType())
        for f in declared.fields]
    kind = _format(path)
    lines = (spark.read.format(kind).option("header", True)
             .option("columnNameOfCorruptRecord", CORRUPT)
             .schema(T.StructType([*as_text, T.StructField(CORRUPT, T.StringType())])).load(path))
    types = {f.name: f.dataType.simpleString() for f in declared.fields
             if not isinstance(f.dataType, nested)}
    checked = type_check(lines, types)
    fits = F.col(CORRUPT).isNull() & (F.size("_rejected") == 0)
    accepted = checked.filter(fits).select(*[
        col(f.name).try_cast(types[f.name]).alias(f.name) if f.name in types else col(f.name)
        for f in declared.fields])
    return accepted, checked.filter(~fits)


def export_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Overwrite a directory with CSV parts."""
    df.write.mode("overwrite").option("header", header).csv(path)
