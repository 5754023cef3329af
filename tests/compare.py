"""Run a catalogue query and its SQL twin, and say where they differ."""

from __future__ import annotations

import contextlib
import io
import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

FAMILIES = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "bigint",
    "float": "float", "double": "double", "varchar": "string", "string": "string",
    "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, Decimal):
        return float(f"{float(value):.12g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and the bag of rows agree."""
    relation = con.sql(sql)
    ours = {f.name: FAMILIES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}
    theirs = {n: FAMILIES.get(str(t).lower(), str(t).lower())
              for n, t in zip(relation.columns, relation.types)}
    found = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    found += [f"type of {n}: {ours[n]} against {theirs[n]}" for n in ours if ours[n] != theirs[n]]
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    right = _rows(relation.columns, relation.fetchall())
    if left != right:
        found.append(f"{sum(left.values())} rows against {sum(right.values())}")
        found += [f"only ours {n}x {str(r)[:400]}" for r, n in list((left - right).items())[:3]]
        found += [f"only SQL  {n}x {str(r)[:400]}" for r, n in list((right - left).items())[:3]]
    if not right:
        found.append("the SQL gives no rows")
    return found


def plan(df) -> str:
    """The formatted physical plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
