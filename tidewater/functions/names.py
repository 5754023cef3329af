"""Column names: quoting, case-insensitive lookup and the audit columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_ID = "_batch_id"
INGESTED_AT = "_ingested_at"
SOURCE_FILE = "_source_file"
AUDIT_COLUMNS = (BATCH_ID, INGESTED_AT, SOURCE_FILE)


def col(name: str, side: str | None = None) -> Column:
    """Reference one top-level column, whatever characters its name holds."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{side}.{quoted}" if side else quoted)


def resolve(columns: Iterable[str], name: str) -> str | None:
    """The spelling under which `name` is held, ignoring case."""
    wanted = name.lower()
    return next((c for c in columns if c.lower() == wanted), None)


def require_columns(df: DataFrame, names: Iterable[str], role: str) -> list[str]:
    """Held spellings of `names`; raises one error that lists every missing one."""
    found = {n: resolve(df.columns, n) for n in names}
    missing = [n for n, held in found.items() if held is None]
    if missing:
        raise ValueError(f"{role} {missing} not in columns {df.columns}")
    return [found[n] for n in found]


def business_columns(df: DataFrame) -> list[str]:
    """Columns that describe the record rather than its delivery."""
    return [c for c in df.columns if c.lower() not in AUDIT_COLUMNS]
