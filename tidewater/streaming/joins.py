"""Joins of two streams whose rows belong together within a time range."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.functions.names import col, require_columns

HOW = ("inner", "left_outer", "right_outer", "full_outer")


@dataclass(frozen=True)
class Side:
    """A stream, its event time, and how late its rows may come."""

    rows: DataFrame
    time: str
    lateness: str


def interval_join(left: Side, right: Side, keys: list[str], earliest: str, latest: str, how: str = "inner") -> DataFrame:
    """Pairs of equal keys whose right time is within [left time + earliest, left time + latest].

    Both sides are buffered in the state store. The watermarks of both and the range say when a row can meet no
    further partner; then it leaves the state, and in an outer join it is released without one if it met none.
    So the state holds the rows of the range and the lateness, whatever came before. Rows later than their watermark
    are dropped. A null key meets nothing. Non-key columns must have different names; keys come once.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    for side in (left, right):
        require_columns(side.rows, [*keys, side.time], "join column")
        if side.rows.schema[side.time].dataType.typeName() != "timestamp":
            raise ValueError(f"event time {side.time!r} must be a timestamp")
    folded = {k.lower() for k in keys}
    names = [{c.lower() for c in side.rows.columns} - folded for side in (left, right)]
    if names[0] & names[1]:
        raise ValueError(f"columns of both sides: {', '.join(sorted(names[0] & names[1]))}")
    marked = [side.rows.withWatermark(side.time, side.lateness).alias(name) for side, name in ((left, "l"), (right, "r"))]
    start, end = (col(left.time, "l") + F.expr(f"INTERVAL '{span}'") for span in (earliest, latest))
    when = col(right.time, "r")
    same = reduce(and_, [col(k, "l") == col(k, "r") for k in keys])
    joined = marked[0].join(marked[1], same & (when >= start) & (when <= end), how)
    key = (lambda k: F.coalesce(col(k, "l"), col(k, "r"))) if how == "full_outer" else (
        lambda k: col(k, "r" if how == "right_outer" else "l"))
    return joined.select(
        *[key(k).alias(k) for k in keys], *[col(c, "l") for c in left.rows.columns if c.lower() not in folded],
        *[col(c, "r") for c in right.rows.columns if c.lower() not in folded])


def start_pairs(pairs: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append each micro-batch's rows to a directory named by the batch; a batch run again overwrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    timing = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return (pairs.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**timing).foreachBatch(write).start())
