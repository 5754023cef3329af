"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import plan
from tidewater.operators import gate, maintenance, merge, quality, relational
from tidewater.operators.conform import batch_filter, conform, latest_by_key


@pytest.fixture
def big(spark):
    """Joins as they are planned when neither side may be broadcast."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def test_collapse_limits_rows_before_the_shuffle(spark, sf):
    text = plan(latest_by_key(lines(spark, sf), ["l_orderkey"], "l_shipdate"))
    assert text.count("Exchange") == 2 and "WindowGroupLimit" in text  # one node, tree and detail
    tree = text.split("\n\n")[0]
    assert tree.index("Exchange") < tree.rindex("WindowGroupLimit")


def test_upsert_shuffles_each_side_once(big, sf):
    rows = lines(big, sf)
    held = rows.filter("l_shipdate < timestamp_ntz '1998-01-01'")
    tree = plan(merge.upsert(held, rows, ["l_orderkey", "l_linenumber"], "l_shipdate")).split("\n\n")[0]
    assert len(re.findall(r"Exchange \(", tree)) == 2


def test_transform_collapses_and_merges_in_two_shuffles(big, sf):
    rows = lines(big, sf).withColumn("_batch_id", F.col("l_returnflag"))
    keys = ["l_orderkey", "l_linenumber"]
    merged = merge.upsert(lines(big, sf), conform(rows, keys, "l_shipdate", "R"), keys, "l_shipdate")
    assert len(re.findall(r"Exchange \(", plan(merged).split("\n\n")[0])) == 2


def test_small_batch_leaves_the_target_in_place(spark, sf):
    held = latest_by_key(lines(spark, sf), ["l_orderkey", "l_linenumber"], "l_shipdate")
    sent = spark.createDataFrame(held.limit(3).collect(), held.schema)
    stored = lines(spark, sf)
    merged = merge.upsert(stored, sent, ["l_orderkey", "l_linenumber"], "l_shipdate", small_batch=True)
    merged.collect()
    final = plan(merged).split("Initial Plan")[0]
    assert "SortMergeJoin" not in final and final.count("BroadcastHashJoin") >= 3


def test_batch_filter_reaches_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "b")
    lines(spark, sf).withColumn("_batch_id", F.col("l_returnflag")).write.partitionBy("_batch_id").parquet(path)
    text = plan(batch_filter(spark.read.parquet(path), "R").select("l_orderkey"))
    assert "PartitionFilters: [isnotnull(_batch_id" in text
    assert "ReadSchema: struct<l_orderkey:bigint>" in text


def test_suite_scans_once_for_all_aggregate_rules(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rules = [{"type": "row_count_min"}, {"type": "completeness", "column": "o_custkey"},
             {"type": "completeness", "column": "o_orderstatus"},
             {"type": "freshness", "column": "o_orderdate"},
             {"type": "business_rule", "predicate": "o_totalprice > 0"}]
    text = plan(quality.quality_suite(orders, rules, "r", "bronze.orders", "2026-01-01"))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1


def test_referential_check_reduces_both_sides_before_joining(big, sf):
    orders = big.read.parquet(f"{sf}/orders.parquet")
    customer = big.read.parquet(f"{sf}/customer.parquet")
    tree = plan(relational.orphan_counts(orders, "o_custkey", customer, "c_custkey")).split("\n\n")[0]
    assert len(re.findall(r"Exchange \(", tree)) == 2 and tree.count("HashAggregate") == 4


def test_expiry_ranks_only_what_it_keeps(big, sf):
    commits = big.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderpriority").alias("table_name"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("committed_at"))
    assert "WindowGroupLimit" in plan(maintenance.snapshots_to_expire(commits, 2))


def test_status_of_datasets_aggregates_before_ranking(spark, sf):
    evidence = entry.queries()["quality_status"](spark, sf)
    assert "WindowGroupLimit" in plan(evidence)
    assert gate.RUN_SCOPE[0] == "run_id"


def test_newest_is_a_bounded_heap(spark, sf):
    assert "TakeOrderedAndProject" in plan(relational.newest(lines(spark, sf), "l_shipdate", 5, ["l_orderkey"]))


def test_flagship_reads_orders_three_times_at_most(spark):
    """Scans that end below the orders file, over all jobs of the flagship."""
    import tidewater.flagship as flagship
    read = []
    scan = flagship.scan

    def counted(session, folder, name):
        read.append(name)
        return scan(session, folder, name)

    flagship.scan = counted
    try:
        text = plan(entry.entry(spark))
    finally:
        flagship.scan = scan
    assert read.count("orders") == 1 and "orders.parquet" not in text
    assert text.count("customer.parquet") <= 2 and "silver" in text


def test_mart_needs_no_distinct_count(spark, sf):
    text = plan(entry.queries()["mart_customer_revenue"](spark, sf))
    assert "distinct" not in text.lower()
