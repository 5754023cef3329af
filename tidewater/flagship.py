"""The whole path in stored steps: deliveries, evidence, gate, silver, gold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.names import BATCH_ID
from tidewater.operators.bronze import append_batch
from tidewater.operators.conform import conform, normalise, stamp
from tidewater.operators.gate import RUN_SCOPE, gate_decision, gated_promote
from tidewater.operators.merge import upsert
from tidewater.operators.products import materialise
from tidewater.operators.quality import quality_suite
from tidewater.session import scratch_path
from tidewater.sources.extract import scan

AS_OF = "2001-08-02 00:00:00"

RULES = [
    {"type": "row_count_min", "name": "delivery_not_empty", "minRows": 1},
    {"type": "completeness", "name": "customer_present", "column": "o_custkey"},
    {"type": "uniqueness", "name": "order_key_unique", "columns": ["o_orderkey"]},
    {"type": "referential_integrity", "name": "customer_known", "column": "o_custkey",
     "referenceTable": "silver.customer", "referenceColumn": "c_custkey"},
    {"type": "freshness", "name": "recent", "severity": "warning", "column": "o_orderdate",
     "maxAgeMinutes": 1440},
]

GOLD = """
SELECT n_name, count(*) AS order_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE) AS revenue
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
GROUP BY n_name
"""


def landing_to_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Orders arrive as two deliveries; each is judged, promoted, merged; gold is rebuilt.

    Bronze, evidence and silver are stored between the steps, as the jobs do, so that each step reads
    its input once.
    """
    def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.partitionBy(*partition_by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    orders, customer = scan(spark, folder, "orders"), scan(spark, folder, "customer")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    first, second = (
        stamp(normalise(rows), batch_id, f"s3://landing/orders-{batch_id}.parquet", AS_OF)
        for rows, batch_id in ((orders.filter(early), "delivery-1"),
                               (orders.filter(~early), "delivery-2")))
    bronze = stored(append_batch(first, second), "bronze", BATCH_ID)
    delivered = lambda batch_id: bronze.filter(F.col(BATCH_ID) == batch_id)

    evidence = stored(reduce(DataFrame.unionByName, [
        quality_suite(delivered(b), RULES, b, "bronze.orders", AS_OF, {"silver.customer": customer})
        for b in ("delivery-1", "delivery-2")]), "evidence")
    decisions = gate_decision(evidence, evidence.select(*RUN_SCOPE))
    promoted = gated_promote(bronze, decisions.withColumnRenamed("run_id", BATCH_ID), [BATCH_ID])

    held, added = (conform(promoted.filter(F.col(BATCH_ID) == b), ["o_orderkey"], "o_orderdate")
                   for b in ("delivery-1", "delivery-2"))
    silver = stored(upsert(held, added, ["o_orderkey"], "o_orderdate"), "silver")
    return materialise(spark, GOLD, {
        "orders": silver, "customer": customer, "nation": scan(spark, folder, "nation")})
