"""Timing summaries, job counters, log redaction."""

from pyspark.sql import functions as F

from tidewater.operators import conform
from tidewater.operators import telemetry as measures
from tidewater.plans.registry import query
from tidewater.session import scratch_path, written
from tidewater.sources.extract import scan


@query("timing_summary", """
WITH timings AS (
  SELECT event_type, CAST(round(value * 1000000) AS BIGINT) AS duration_ns FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY duration_ns) AS rank,
         count(*) OVER (PARTITION BY event_type) AS n FROM timings)
SELECT event_type, count(*) AS samples, CAST(sum(duration_ns) AS BIGINT) // 1000000 AS total_ms,
       (CAST(sum(duration_ns) AS BIGINT) // count(*)) // 1000000 AS mean_ms,
       min(duration_ns) // 1000000 AS min_ms,
       min(duration_ns) FILTER (rank >= ceil(CAST(0.5 AS DOUBLE) * n)) // 1000000 AS p50_ms,
       min(duration_ns) FILTER (rank >= ceil(CAST(0.95 AS DOUBLE) * n)) // 1000000 AS p95_ms,
       max(duration_ns) // 1000000 AS max_ms
FROM ranked GROUP BY event_type""")
def timing_summary(spark, folder):
    timings = scan(spark, folder, "events").select(
        "event_type", F.round(F.col("value") * 1_000_000).cast("bigint").alias("duration_ns"))
    return measures.timing_summary(timings, "event_type", "duration_ns")


@query("timing_merged", """
SELECT event_type, count(*) AS samples, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS total,
       min(CAST(round(value * 1000000) AS BIGINT)) AS lowest, max(CAST(round(value * 1000000) AS BIGINT)) AS highest,
       TRUE AS p50_close, TRUE AS p95_close
FROM events GROUP BY event_type""")
def timing_merged(spark, folder):
    """Daily states stored, then merged per metric; whether the quantiles' ranks are within 2 % of those asked for."""
    timings = scan(spark, folder, "events").select(
        "event_type", F.to_date("ts").alias("day"), F.round(F.col("value") * 1_000_000).cast("bigint").alias("duration_ns"))
    states = written(spark, measures.timing_states(timings, "event_type", "duration_ns", "day"), scratch_path(spark, "timings"))
    merged = measures.timing_quantiles(measures.merged_timings(states, ["event_type"]), {"p50": 0.5, "p95": 0.95})
    merged = written(spark, merged, scratch_path(spark, "quantiles"))  # a row per metric
    ranks = timings.join(merged.select("event_type", "p50", "p95"), "event_type").groupBy("event_type").agg(*[
        (F.avg((F.col("duration_ns") <= F.col(name)).cast("int")).between(q - 0.02, q + 0.02)).alias(f"{name}_close")
        for name, q in (("p50", 0.5), ("p95", 0.95))])
    return merged.drop("p50", "p95").join(ranks, "event_type")


# Each counter as an expression both engines read the same way.
COUNTERS = {
    "executor_run_ms": "CAST(l_quantity AS BIGINT)",
    "executor_cpu_ns": "CAST(round(l_extendedprice * 1000) AS BIGINT)",
    "deserialize_ms": "CAST(l_linenumber AS BIGINT)",
    "result_serialization_ms": "CAST(round(l_tax * 100) AS BIGINT)",
    "jvm_gc_ms": "CAST(round(l_discount * 100) AS BIGINT)",
    "result_bytes": "l_suppkey",
    "input_bytes": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "input_records": "l_partkey",
    "output_bytes": "CAST(round(l_extendedprice * 10) AS BIGINT)",
    "output_records": "CAST(l_quantity AS BIGINT) * 2",
    "shuffle_read_bytes": "CASE WHEN l_returnflag = 'R' THEN l_partkey * 100 ELSE 0 END",
    "shuffle_read_records": "CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE 0 END",
    "shuffle_write_bytes": "CASE WHEN l_returnflag = 'A' THEN l_partkey * 100 ELSE 0 END",
    "shuffle_write_records": "CASE WHEN l_returnflag = 'A' THEN l_partkey ELSE 0 END",
    "memory_spill_bytes": "CASE WHEN l_linestatus = 'O' THEN l_suppkey * 10 ELSE 0 END",
    "disk_spill_bytes": "CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE 0 END",
}


@query("operation_rollup", """
SELECT 'op_' || c_nationkey AS operation_id, count(DISTINCT c_custkey) AS jobs,
       count(DISTINCT o_orderkey) AS stages, count(l_orderkey) AS tasks,
       CAST(coalesce(sum(%s), 0) AS BIGINT) // 1000000 AS executor_cpu_ms,
       (SELECT CAST(sum(greatest(CAST(round(c_acctbal) AS BIGINT), 0)) AS BIGINT) FROM customer k
        WHERE k.c_nationkey = customer.c_nationkey) AS scheduler_ms, %s
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY c_nationkey""" % (COUNTERS["executor_cpu_ns"], ", ".join(
    f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {n}" for n, e in COUNTERS.items()
    if n != "executor_cpu_ns")))
def operation_rollup(spark, folder):
    """Lineitem rows are tasks, orders stages, customers jobs, nations operations."""
    tasks = scan(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("stage_id"), *[F.expr(e).alias(n) for n, e in COUNTERS.items()])
    stages = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("stage_id"), F.col("o_custkey").alias("job_id"))
    jobs = scan(spark, folder, "customer").select(
        F.col("c_custkey").alias("job_id"),
        F.concat(F.lit("op_"), F.col("c_nationkey").cast("string")).alias("operation_id"),
        F.round("c_acctbal").cast("bigint").alias("scheduler_ms"))
    return measures.operation_rollup(tasks, stages, jobs)


# Texts that hold no secret: what could introduce one, and quotes, are replaced.
CARRIER = "(?i)secret|password|token|credential|authorization|key|bearer|://|[\"']"


@query("redact_secrets", f"""
WITH carried AS (
  SELECT *, translate(regexp_replace(text, '{CARRIER.replace("'", "''")}', '#', 'g'), chr(13) || chr(10) || chr(9), '___') AS c
  FROM documents)
SELECT doc_id, c || ' db_password = <redacted>, ' || c || '_"private-key":<redacted>;_ftp://<redacted>@' || lang || '/'
         || c || ' Token <redacted>' AS text,
       'login ' || lang || ' password=<redacted>, via https://<redacted>@' || source || '/' || doc_id
         || ' as {{"api.key": <redacted>, "n": [' || n_chars || ', token <redacted>]}} Bearer <redacted>; done' AS line
FROM carried""")
def redact_secrets(spark, folder):
    """A log line per document, and its text with secrets put in; the SQL states what must come out."""
    secret = F.md5(F.col("doc_id").cast("string"))
    line = F.concat(
        F.lit("login "), "lang", F.lit(" password="), secret, F.lit(", via https://u"), "doc_id", F.lit(":"), secret, F.lit("@"),
        "source", F.lit("/"), "doc_id", F.lit(' as {"api.key": "'), secret, F.lit(' and more", "n": ['), "n_chars",
        F.lit(", token '"), secret, F.lit(" x']} Bearer "), secret, F.lit(".y; done"))
    carrier = F.regexp_replace("text", CARRIER, "#")
    text = F.concat(carrier, F.lit(" db_password = "), secret, F.lit(":=x, "), carrier, F.lit('\n"private-key":"'), secret,
                    F.lit(' 1, 2";\tftp://a@b:'), secret, F.lit("@"), "lang", F.lit("/"), carrier, F.lit(" Token '"), secret, F.lit("'"))
    rows = scan(spark, folder, "documents").select("doc_id", text.alias("text"), line.alias("line"))
    return conform.redact_secrets(conform.redact_secrets(rows, "text"), "line")
