"""The queries of this subpackage over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import (
    ann, decontaminate, langid, licenses, linededup, mixing, neardup, pii, prefixtrie, suffixindex, toxicity, vectorcodes, warc,
)
from tidewater.llm.common import held_out
from tidewater.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    import corpus_pipeline

    _ORACLES.update({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return dict(_QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = toxicity.toxicity(docs, labels, usable=~held_out(F.col("doc_id")))
    evidence = F.transform("evidence", lambda e: F.concat_ws(
        ":", e["example"], F.format_number(e["similarity"], 4), e["toxic"].cast("string")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                        F.array_join(evidence, ",").alias("evidence"))


@query("op2_mixing", r"""
WITH sized AS (
    SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
), filled AS (  -- clamping sources in the order of cap / weight, the level is highest where it is right
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
              / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
    FROM sources
    WINDOW before AS (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, CASE WHEN weight * water > 3 * source_size
                                     THEN CAST(3 * source_size AS DOUBLE) ELSE weight * water END AS target
    FROM sources, (SELECT coalesce(max(level), 0.0) AS water FROM filled)
), ordered AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id, s.size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size * size
            + greatest(0, least(size, goal % source_size - ahead)) END AS BIGINT) AS taken
FROM ordered""")
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op5_decontamination", r"""
WITH doc_words AS (
    SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '),
                               lambda w: w <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL
), item_words AS (
    SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '),
                                lambda w: w <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL
), doc_shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(
        range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM doc_words WHERE len(w) > 0
), item_shingles AS (
    SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(
        range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM item_words WHERE len(w) > 0
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT d.doc_id, i.item_id, any_value(n) AS item_shingles, count(*) AS shared,
       count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM doc_shingles d JOIN item_shingles i ON d.shingle = i.shingle JOIN sizes s ON s.item_id = i.item_id
GROUP BY d.doc_id, i.item_id
HAVING count(*) >= any_value(n) - floor(any_value(n) * (1 - 0.8::DOUBLE) + 1e-9)""")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_warc", r"""
WITH digested AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (  -- base 32 of the 20 bytes: 32 groups of 5 bits
    SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(((CAST('0x' || substr(hex || '000', 1 + (i * 5) // 4, 3) AS INTEGER)
                   >> (12 - 5 - (i * 5) % 4)) & 31) AS INTEGER), 1)), '') AS base32
    FROM (SELECT DISTINCT hex FROM digested)
), heads AS (SELECT hex, max(page_id) AS head, count(*) AS n FROM digested GROUP BY hex)
SELECT page_id, octet_length(payload) AS payload_bytes, base32 AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM digested JOIN bits USING (hex) JOIN heads USING (hex)""")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, folder, "pages"), scratch_path(spark, "archives"))
    return warc.read_archives(manifest, payloads=False).drop("url")


@query("op4_near_dedup", r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE doc_id IS NOT NULL
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(
        range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle
    FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * common >= 85 * (a.n + b.n - common)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT x, y FROM edges
    UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), least AS (SELECT x, min(y) AS smallest FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
       least(d.doc_id, coalesce(smallest, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(smallest, d.doc_id)) IS NOT DISTINCT FROM d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON least.x = d.doc_id""")
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op7_language")
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return langid.identify(docs, learn=out).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op8_licenses")
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", s["label"], s["first"].cast("string"), s["end"].cast("string"), s["edits"].cast("string"))), ",")
    return licenses.scan_licenses(table(spark, folder, "documents")).withColumn("spans", spans)


@query("op9_nearest")
def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query("op10_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), held AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING min(doc_id) < max(doc_id)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
                       FILTER (first IS NULL OR doc_id IS NULL OR doc_id <= first), '')) AS kept_sha256
FROM keyed LEFT JOIN held ON keyed.key = held.key AND length(keyed.key) >= 10
GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixindex.dedup_passages(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_prefix_trie", r"""
WITH turns AS (
    SELECT conv_id AS c, reference, n_words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, reference) AS pos
    FROM (SELECT *, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text)) AS reference,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM conversations)
    WHERE conv_id IS NOT NULL
), convs AS (  -- the low bits of the CRC of the id's digits, bit by bit
    SELECT c, count(*) AS n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
        string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END
        ), 4294967295) % 4 AS h
    FROM turns GROUP BY c
), rebuilt AS (
    SELECT c.c, t.pos AS d, reference, n_words FROM convs c JOIN turns t ON t.c = c.c - c.c % 20 AND t.pos <= c.h
    UNION ALL
    SELECT t.c, least(c.h, coalesce(b.n, 0)) + t.pos - c.h, reference, n_words
    FROM turns t JOIN convs c ON c.c = t.c LEFT JOIN convs b ON b.c = c.c - c.c % 20 WHERE t.pos > c.h
), sequences AS (
    SELECT c, coalesce(s, []) AS s, coalesce(w, []) AS w FROM convs LEFT JOIN (
        SELECT c, list(reference ORDER BY d) AS s, list(n_words ORDER BY d) AS w FROM rebuilt GROUP BY c) USING (c)
), prefixes AS (
    SELECT c, d, array_to_string(s[1:d], ' ') AS prefix, CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], ' ') END AS above,
           w[d] AS words, d = len(s) AS ends
    FROM sequences, unnest(range(0, len(s) + 1)) AS depths(d)
), nodes AS (
    SELECT d, prefix, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY d, prefix
), kids AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), subtrees AS (
    SELECT t.top_d AS d, t.top AS prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
           sum((n.n_convs - 1) * n.words) AS saved_tokens
    FROM (SELECT DISTINCT a.d AS top_d, a.prefix AS top, b.d, b.prefix FROM prefixes a JOIN prefixes b ON a.c = b.c AND a.d <= b.d) t
    JOIN nodes n ON n.d = t.d AND n.prefix = t.prefix LEFT JOIN kids k ON k.d = t.d AND k.prefix = t.prefix GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.above
LEFT JOIN kids k ON k.d = n.d AND k.prefix = n.prefix JOIN subtrees s ON s.d = n.d AND s.prefix = n.prefix""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, folder, "conversations")).drop("turn")


def _codes_sql() -> str:
    """Four Lloyd rounds over all pairs of parts and entries."""
    def nearest(round_: int) -> str:
        return f"""nearest{round_} AS MATERIALIZED (
    SELECT x.p, x.row, any_value(x.v) AS v, min({{'d': CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v)
        + list_inner_product(c.v, c.v) AS BIGINT), 'e': c.e}}) AS best
    FROM parts x JOIN book{round_} c ON c.p = x.p GROUP BY x.p, x.row)"""

    def moved(round_: int) -> str:
        return f"""book{round_ + 1} AS MATERIALIZED (
    SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM book{round_} c LEFT JOIN (
        SELECT p, e, list(CAST(floor(total / n) AS DOUBLE) ORDER BY i) AS v FROM (
            SELECT p, best.e AS e, i, sum(v[i]) AS total, count(*) AS n
            FROM nearest{round_}, range(1, 1 + len(v)) AS places(i) GROUP BY ALL) GROUP BY p, e) n
    ON n.p = c.p AND n.e = c.e)"""

    rounds = ",\n".join(f"{nearest(r)},\n{moved(r)}" for r in range(4))
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label,
           list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT p, row, v[1 + p * (len(v) // 4):(p + 1) * (len(v) // 4)] AS v FROM kept, range(4) AS numbers(p)
), book0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM parts WHERE row <= 256),
{rounds},
{nearest(4)},
coded AS (
    SELECT row, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM nearest4 GROUP BY row
), books AS (
    SELECT sha256(string_agg(CAST(CAST(c.v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM book4 c, range(1, 1 + len(c.v)) AS places(i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), books"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, folder, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(vectorcodes.digest(books)))
