"""Schema drift between two halves of a field registry."""

from pyspark.sql import functions as F

from tidewater.operators import schema
from tidewater.operators.conform import latest_by_key
from tidewater.plans.inputs import at
from tidewater.plans.registry import query
from tidewater.sources.extract import scan

# The types the registry's declarations name.
TYPES = ("int", "bigint", "float", "double", "decimal(10,2)", "decimal(12,2)", "decimal(12,3)",
         "string", "date", "timestamp")
TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def _declared(events, upper: bool):
    """The newest type each (table, column) was declared with; an event is a declaration."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.floor(k / 10) + 1).cast("int"))
    name = F.concat(F.lit("C_" if upper else "c_"), F.col("user_id").cast("string"))
    rows = events.select(F.col("event_type").alias("table_name"), name.alias("column_name"),
                         kind.alias("data_type"), "ts", "event_id")
    return latest_by_key(rows, ["table_name", "column_name"], "ts", ["event_id"]).select(
        "table_name", "column_name", "data_type")


def _both(spark, folder):
    events = scan(spark, folder, "events")
    return (_declared(events.filter(F.col("ts") < at("2024-01-16")), upper=False),
            _declared(events.filter(F.col("ts") >= at("2024-01-16")), upper=True))


DRIFT = f"""
declared AS (
  SELECT event_type AS table_name, user_id, ts >= '2024-01-16' AS later,
         ({TYPE_LIST})[CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) // 10 + 1] AS data_type
  FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id, ts >= '2024-01-16'
                             ORDER BY ts DESC, event_id) = 1),
sides AS (
  SELECT coalesce(h.table_name, i.table_name) AS table_name, coalesce(h.user_id, i.user_id) AS user_id,
         h.data_type AS held_type, i.data_type AS incoming_type
  FROM (SELECT * FROM declared WHERE NOT later) h
  FULL JOIN (SELECT * FROM declared WHERE later) i USING (table_name, user_id)),
drift AS (
  SELECT table_name, CASE WHEN held_type IS NULL THEN 'C_' ELSE 'c_' END || user_id AS column_name,
         held_type, incoming_type,
         CASE WHEN held_type IS NULL THEN 'added' WHEN incoming_type IS NULL THEN 'missing'
              WHEN held_type = incoming_type THEN 'same'
              WHEN (held_type, incoming_type) IN (('int', 'bigint'), ('float', 'double'),
                                                  ('decimal(10,2)', 'decimal(12,2)')) THEN 'widened'
              ELSE 'conflict' END AS change
  FROM sides)
"""


@query("schema_drift", "WITH" + DRIFT + """
SELECT *, CASE WHEN change = 'conflict' THEN column_name || ': table holds ' || held_type
               || ', batch carries ' || incoming_type END AS conflict
FROM drift""")
def schema_drift(spark, folder):
    held, incoming = _both(spark, folder)
    return schema.schema_drift(held, incoming)


@query("contract_check", "WITH" + DRIFT + """
SELECT table_name, count(*) FILTER (change IN ('missing', 'conflict')) AS breaking,
       count(*) FILTER (change = 'widened') AS review, count(*) FILTER (change = 'added') AS added,
       count(*) FILTER (change IN ('missing', 'conflict')) > 0 AS needs_approval
FROM drift GROUP BY table_name""")
def contract_check(spark, folder):
    held, incoming = _both(spark, folder)
    return schema.contract_check(held, incoming)
