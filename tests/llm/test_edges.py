"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import ann, decontaminate, langid, licenses, linededup, mixing, neardup, pii, toxicity, warc
from tidewater.session import scratch_path

LONG = "\n".join(f"long line number {i} of a very long text" for i in range(30_000))
#: Columns named like those that operators use on the way.
CLASHING = ("size", "node", "doc", "hash", "words", "found", "key", "lost", "n_lines", "n_dropped", "suspected", "gone",
            "outcome", "lost_by", "member", "rank", "weight", "score", "example", "toxic", "vector", "id")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "same words here in this line\nand more of the same", "en", "a"),
            (2, "same words here in this line\nand more of the same", "en", "a"),
            (2, "same words here in this line\nand more of the same", "en", "a"),
            (3, None, "en", None), (4, "", None, ""), (5, " \t\n ", "de", "b"), (None, "same words here in this line", "en", "a"),
            (None, None, None, None), (6, LONG, "en", "b"), (7, "ﬁ é 漢字 \x00 \U0001F600", "fr", "ü"), (8, "one", "en", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn(
        "n_chars", F.length("text").cast("long"))
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit(name))
    return frame


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int").withColumn(
        "score", F.lit(9.0))


def items(spark):
    return spark.createDataFrame([(1, "same words here in this line and more"), (2, None), (None, "x"), (3, ""), (4, "one"),
                                  (1, "same words here in this line")], "item_id long, text string").withColumn("n", F.lit("n"))


def test_line_dedup(docs):
    got = linededup.dedup_lines(docs)
    assert set(got.columns) == set(docs.columns)  # n_lines and n_dropped take the place of columns of that name
    rows = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str)
    assert (2, "", 2, 2) in rows and rows.count((2, "", 2, 2)) == 2 and (3, None, 1, 0) in rows and (4, "", 1, 0) in rows
    assert (None, "same words here in this line", 1, 0) in rows and (6, LONG, 30_000, 0) in rows and len(rows) == 11


def test_near_duplicates(docs):
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, width=3, percent=85).collect()), key=str)
    assert got.count((2, 9, 1, False)) == 2 and (1, 9, 1, True) in got and (3, 0, 3, True) in got
    assert (5, 0, 5, True) in got and (8, 1, 8, True) in got and (None, 4, None, True) in got and len(got) == 11


def test_decontamination(spark, docs):
    got = sorted(map(tuple, decontaminate.contaminated(docs, items(spark)).select("doc_id", "item_id", "containment").collect()))
    assert got == [(1, 1, 1.0), (2, 1, 1.0), (8, 4, 1.0)]


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == 11 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    by = {}
    for r in got:
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 0.5 for (_, target), taken in by.items())


def test_toxicity(spark, docs):
    got = toxicity.toxicity(docs, labels(spark)).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)


def test_personal_data_languages_and_licenses(docs):
    assert all(r["base"] == [] for r in pii.find_personal_data(docs).collect() if r["doc_id"] != 6)
    langs = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).collect()}
    assert (3, "und") in langs and (4, "und") in langs and (5, "und") in langs and len(langs) >= 9
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == 11 and {r["n_words"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in got)


def test_one_language_and_no_language(spark):
    rows = spark.createDataFrame([(1, "abc", "en"), (2, "xyz", None), (3, "123", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows).collect()} == {1: "en", 2: "en", 3: "und"}
    none = langid.identify(rows.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_warc_of_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, None, "x"), (None, "u", None)],
                                  "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("head", F.lit(2))
    got = warc.read_archives(warc.write_archives(pages, scratch_path(spark, "archives")), payloads=False).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [
        ("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_empty_tables(spark, docs):
    none, no_labels, no_items = docs.limit(0), labels(spark).limit(0), items(spark).limit(0)
    assert linededup.dedup_lines(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert decontaminate.contaminated(none, items(spark)).count() == 0
    assert decontaminate.contaminated(docs, no_items).count() == 0
    assert mixing.mix(none).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, no_labels).collect()} == {0.0}
    assert toxicity.toxicity(none, labels(spark)).count() == 0
    assert pii.find_personal_data(none).count() == langid.identify(none).count() == licenses.scan_licenses(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, lambda i: i % 20 == 0).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, scratch_path(spark, "archives"))).count() == 0


def test_stages_keep_columns_and_clean_rows(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {3, 4, 5, 6, 7} <= {r["doc_id"] for r in out.collect()}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    changed = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert changed[2]["text"] == "" and changed[2]["n_chars"] == 0 and changed[2]["n_lines"] == "n_lines"
