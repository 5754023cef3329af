"""Bronze row shaping: cleaning, audit columns, deduplication, typing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.names import (
    AUDIT_COLUMNS, BATCH_ID, INGESTED_AT, SOURCE_FILE, business_columns, col, require_columns,
    resolve,
)
from tidewater.functions.text import blank_to_null, redact
from tidewater.functions.time import instant


def normalise(df: DataFrame) -> DataFrame:
    """Trim every top-level string; a blank one becomes null. One projection."""
    return df.select(*[
        blank_to_null(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
        else col(f.name)
        for f in df.schema.fields
    ])


def stamp(df: DataFrame, batch_id: str | Column, source_file: str | Column,
          now: datetime | str) -> DataFrame:
    """Add the audit columns. The ingest time is the caller's clock, not the engine's."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({
        BATCH_ID: as_column(batch_id),
        INGESTED_AT: instant(now),
        SOURCE_FILE: as_column(source_file),
    })


def align_schema(df: DataFrame, held: T.StructType) -> DataFrame:
    """Held column order first, typed nulls for what is missing, new columns last."""
    projection = []
    for field in held.fields:
        match = resolve(df.columns, field.name)
        value = col(match) if match else F.lit(None).cast(field.dataType)
        projection.append(value.alias(field.name))
    projection += [col(c) for c in df.columns if resolve(held.fieldNames(), c) is None]
    return df.select(*projection)


def require_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; reading a null in one of the columns fails the job that writes them.

    Parquet does not enforce required columns, so the check rides along with the write
    instead of costing a pass of its own.
    """
    names = require_columns(df, columns, "required column")
    return df.withColumns({
        n: F.coalesce(col(n), F.raise_error(F.lit(f"null in required column {n}")))
        for n in names})


def batch_filter(df: DataFrame, batch_id: str) -> DataFrame:
    """One delivery; prunes to its directory when the table is partitioned by batch."""
    return df.filter(F.col(BATCH_ID) == batch_id)


def batch_is_held(df: DataFrame, batch_id: str) -> bool:
    """Whether any row of the delivery is held; stops at the first row found."""
    return not batch_filter(df, batch_id).select(BATCH_ID).limit(1).isEmpty()


def batch_conflicts(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Incoming batch ids that are held already, with the rows on both sides."""
    held_rows = held.groupBy(BATCH_ID).agg(F.count("*").alias("held_rows"))
    new_rows = batch.groupBy(BATCH_ID).agg(F.count("*").alias("incoming_rows"))
    return new_rows.join(held_rows, BATCH_ID)


def drop_audit(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in AUDIT_COLUMNS])


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Collapse rows that are equal in every column."""
    return df.distinct()


def latest_by_key(df: DataFrame, keys: list[str], seq: str,
                  ties: list[str] | None = None) -> DataFrame:
    """One row per key: highest sequence, nulls last, then a total order of columns.

    Ties are broken on real columns in declared order (all business columns unless
    `ties` names some), so the same input gives the same winner on every run and a
    replayed delivery does not change it. Catalyst turns the rank filter into a
    WindowGroupLimit below the shuffle: each map task sends at most one row per key,
    so a key that holds a third of the table does not become one long task.
    """
    keys = require_columns(df, keys, "business key")
    (seq,) = require_columns(df, [seq], "sequence column")
    if ties is None:
        fixed = {seq.lower(), *(k.lower() for k in keys)}
        ties = [c for c in business_columns(df) if c.lower() not in fixed]
    order = [col(seq).desc_nulls_last(), *[col(t).asc_nulls_first() for t in ties]]
    newest = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(newest))
            .filter(F.col("_rank") == 1).drop("_rank"))


def conform(df: DataFrame, keys: list[str], seq: str, batch_id: str | None = None,
            ties: list[str] | None = None) -> DataFrame:
    """Bronze rows as silver takes them: one batch or all, newest per key, no audit."""
    require_columns(df, keys, "business key")
    require_columns(df, [seq], "sequence column")
    scope = df
    if batch_id is not None:
        if not batch_is_held(df, batch_id):
            raise ValueError(f"batch {batch_id!r} has no rows; nothing would be merged")
        scope = batch_filter(df, batch_id)
    return latest_by_key(drop_audit(scope), keys, seq, ties)


def event_time_fallback(df: DataFrame, event_col: str, processing_time: datetime | str) -> DataFrame:
    """Keep event and processing time apart; use the latter only where needed, and say so."""
    return df.withColumns({
        "processing_time": instant(processing_time),
        "effective_time": F.coalesce(col(event_col).cast("timestamp"), instant(processing_time)),
        "event_time_missing": col(event_col).isNull(),
    })


def redact_secrets(df: DataFrame, column: str, cap: int | None = None) -> DataFrame:
    """Replace the column by its masked, one-line form; whole text unless a cap is given."""
    return df.withColumn(column, redact(col(column), cap))


def type_check(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns; `_rejected` lists those whose text did not fit."""
    names = require_columns(df, types, "typed column")
    wanted = dict(zip(names, types.values()))
    failed = F.filter(
        F.array(*[
            F.when(col(n).isNotNull() & col(n).try_cast(t).isNull(), F.lit(n))
            for n, t in wanted.items()
        ]),
        lambda name: name.isNotNull(),
    )
    return df.withColumn("_rejected", failed)


def typed_conform(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, untouched rows with the names of the columns that did not fit)."""
    checked = type_check(df, types)
    names = dict(zip(require_columns(df, types, "typed column"), types.values()))
    accepted = checked.filter(F.size("_rejected") == 0).select(*[
        col(c).try_cast(names[c]).alias(c) if c in names else col(c) for c in df.columns
    ])
    return accepted, checked.filter(F.size("_rejected") > 0)
