"""Operators against plain Python, and their own promises."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewater.llm import ann, decontaminate, langid, licenses, linededup, mixing, neardup, pii, toxicity, warc
from tidewater.llm.common import held_out, shingle_set
from tidewater.llm.components import components
from tidewater.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("max_bits", [linededup.MAX_BITS, 1])
def test_line_dedup_is_exact_at_any_filter_size(spark, sf, max_bits):
    docs = documents(spark, sf)
    got = linededup.dedup_lines(docs, max_bits=max_bits).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute.line_dedup(pairs(docs)))


def test_a_full_filter_still_gives_the_right_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BITS_PER_KEY", 1)
    rows = [(i, "\n".join(f"line number {random.Random(i * 7 + j).randrange(4000)}" for j in range(40)), "en", "a")
            for i in range(300)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(7), max_bits=1)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == sorted(
        brute.line_dedup([r[:2] for r in rows]))


def test_near_duplicates_match_brute_force(spark, sf):
    docs = documents(spark, sf)
    for width, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, width=width, percent=percent).collect()}
        assert got == brute.near_duplicates(pairs(docs), width, percent)


def test_near_copies_in_large_groups_and_borderline_links(spark):
    """Groups beyond a leaf, with copies that link only to some members, and chains of links."""
    dice = random.Random(5)
    rows = []
    for group in range(4):
        seed = [f"g{group}w{dice.randrange(900)}" for _ in range(120)]
        for member in range(150):
            words = list(seed)
            for _ in range(dice.choice([0, 1, 2, 3, 4, 5, 6])):
                words[dice.randrange(len(words))] = f"x{dice.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(words), "en", "a"))
    chain = [f"c{i}" for i in range(160)]
    rows += [(len(rows) + i, " ".join(chain[4 * i:4 * i + 60]), "en", "a") for i in range(25)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, width=3, percent=85).collect()}
    expected = brute.near_duplicates([r[:2] for r in rows], 3, 85)
    assert len(set(expected.values())) > 8
    assert got == expected


def test_trees_follow_the_recall_asked_for():
    for percent in (80, 85, 95):
        trees = neardup.trees_for(percent, 0.9998)
        missed = lambda n: (1 - (percent / 100) ** neardup.LAST_LEVEL) ** n  # noqa: B023,E731
        assert missed(trees) <= 0.0002 < missed(trees - 1)
    assert neardup.trees_for(85, 0.9998) == 12


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)] + [("h", f"s{i}") for i in range(500)] + [("z", "z")]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert {got[f"{i:04d}"] for i in range(301)} == {"0000"}
    assert {v for k, v in got.items() if k[0] in "hs"} == {"h"} and "z" not in got


def test_shingles_are_those_of_words():
    text = "One two\tTHREE one two\x0bthree one"
    assert len(shingle_set(text.encode(), 3)) == len(brute.shingles(brute.split_words(text), 3))
    assert len(shingle_set(b"a b", 3)) == 1 and len(shingle_set(b" \n", 3)) == 0
    assert (shingle_set(b"A b C", 3) == shingle_set(b"a  b\nc", 3)).all()
    assert (shingle_set("É".encode(), 3) != shingle_set("é".encode(), 3)).all()


def test_decontamination_matches_brute_force(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontaminate.contaminated(docs, items).select("doc_id", "item_id", "item_shingles", "shared").collect()
    expected = brute.contaminated(pairs(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    assert expected and set(map(tuple, got)) == expected


def test_decontamination_at_the_threshold(spark):
    item = [f"w{i}" for i in range(54)]  # 50 shingles, 40 needed
    docs = [(i, " ".join(["before"] * 300 + item[:44 + i - 1] + ["after"] * 2000), "en", "a") for i in range(3)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(
        [(1, " ".join(item).upper())], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["shared"] for r in got} == {1: 40, 2: 41}


def test_mix_matches_repeated_clamping(spark, sf):
    docs = documents(spark, sf)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    expected = brute.mix([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    assert sorted((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, got)) == sorted(
        (*r[:3], round(r[3], 6), r[4]) for r in expected)


def test_mix_clamps_in_rounds_and_meets_targets(spark):
    sizes = {"a": 1, "b": 4, "c": 9, "d": 30, "e": 500, None: 2000}
    rows = [(i, "w " * 7, "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    expected = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r[0], r[4]) for r in expected)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 0.5 for (_, target), taken in by.items())


def test_warc_round_trip_with_dictionary_and_revisits(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    copies = pages.limit(20).withColumn("page_id", F.col("page_id") + 10 ** 6)
    extra = spark.createDataFrame([(-1, None, None), (-2, "http://a/%20\r\nX: é", ""), (-3, "u", "\r\n\r\nWARC/1.1\r\n")], pages.schema)
    all_pages = pages.union(copies).union(extra)
    manifest = warc.write_archives(all_pages, scratch_path(spark, "archives"))
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    rows = {r["page_id"]: r for r in all_pages.collect()}
    assert set(got) == set(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    for page_id, row in rows.items():
        record, payload = got[page_id], (row["html"] or "").encode()
        assert record["url"] == row["url"] and record["payload_bytes"] == len(payload)
        if record["record_type"] == "response":
            assert bytes(record["payload"]) == payload
        else:
            assert (rows[record["refers_to"]]["html"] or "") == (row["html"] or "") and record["refers_to"] > page_id
    assert sum(r["record_type"] == "revisit" for r in got.values()) == 20 + 1


def test_archives_start_with_their_dictionary(tmp_path):
    import struct

    import zstandard

    records = [warc.to_record(i, f"http://x/{i}", (f"<p>page {i} " + "boiler plate text " * 40).encode(), b"\0" * 20, 1)
               for i in range(300)]
    with open(tmp_path / "a.warc.zst", "wb") as out:
        writer = warc.ArchiveWriter(out)
        for record in records:
            writer.add(record)
        writer.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE
    with open(tmp_path / "a.warc.zst", "rb") as source:
        assert list(warc.read_archive(source)) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - struct.unpack("<I", data[4:8])[0] < plain
    with open(tmp_path / "a.warc.zst", "ab") as out:
        out.truncate(len(data) - 3)
    with open(tmp_path / "a.warc.zst", "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(source))


def test_small_payloads_are_not_compared(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "same but longer"),
                                   (4, "u", "same but longer")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, scratch_path(spark, "archives"), min_bytes=5)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
            r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    import re

    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 10 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def test_base_spans_are_those_of_the_patterns(spark, sf):
    dice = random.Random(2)
    made = ["".join(dice.choice("ab@@..1234 +-()9é\n") for _ in range(60)) for _ in range(4000)]
    made += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "1.2.3", "é@é.com", "x@y", "+1 (234) 567-8901.", "@", ""]
    made += [text for _, text in pairs(documents(spark, sf)) if text]
    for text in made:
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_scanned_once():
    import time

    start = time.perf_counter()
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+" * 100_000 + "1", "a@" * 50_000):
        pii.base_spans(text)
    assert time.perf_counter() - start < 5


def test_tagger_gradients_are_those_of_its_loss():
    dice = np.random.default_rng(0)
    tagger = pii.Tagger.fresh()
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    codes = dice.integers(0, pii.SYMBOLS, (2, pii.WINDOW)).astype(np.uint8)
    tags = dice.integers(0, pii.TAGS, (2, pii.WINDOW)).astype(np.uint8)

    def loss():
        scores, moves, total = tagger.scores(codes).astype(np.float64), tagger.weights["moves"], 0.0
        for n in range(2):
            ahead, gold = scores[0, n], scores[0, n, tags[n, 0]]
            for step in range(1, len(scores)):
                ahead = np.logaddexp.reduce(ahead[:, None] + moves, axis=0) + scores[step, n]
                gold += moves[tags[n, step - 1], tags[n, step]] + scores[step, n, tags[n, step]]
            total += np.logaddexp.reduce(ahead) - gold
        return total / 2

    for name, slopes in tagger.gradients(codes, tags).items():
        place = (codes[0, 5], 2) if name == "embedding" else tuple(dice.integers(0, n) for n in slopes.shape)
        weights = tagger.weights[name]
        kept = weights[place]
        weights[place] = kept + 1e-3
        up = loss()
        weights[place] = kept - 1e-3
        down = loss()
        weights[place] = kept
        assert abs((up - down) / 2e-3 - slopes[place]) < 2e-3


def test_tagger_learns_spans_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text RLIKE '[0-9@]'")
    tagger = pii.train(docs.filter("doc_id % 4 <> 0"), F.col("text"))
    found = held = right = 0
    for r in docs.filter("doc_id % 4 = 0").select("text").collect():
        codes = pii.encode(r["text"])
        starts = pii.window_starts(codes)
        if not len(starts):
            continue
        tags, _ = tagger.decode(pii.window_codes(codes, starts))
        for start, row in zip(starts, tags):
            gold = pii._tags(pii.base_spans(r["text"]), int(start))
            held += (gold % 2 == 1).sum()
            found += (row % 2 == 1).sum()
            right += ((gold == row) & (gold % 2 == 1)).sum()
    assert held > 100 and right / held > 0.7 and right / found > 0.7


def test_windows_agree_on_one_set_of_spans():
    text = "call 555 010 9999 or mail a@b.com now"
    base = [(0, 26, 33)]
    offered = [(0.99, (3, 5, 17)), (0.95, (3, 9, 17)), (0.99, (0, 24, 33)), (0.5, (3, 5, 16))]
    assert pii.reconciled(base, offered, text) == [(3, 5, 17), (0, 26, 33)]


def test_windows_cover_every_anchor_twice_over():
    codes = pii.encode("x" * 500 + "5" + "y" * 500 + "@")
    starts = pii.window_starts(codes)
    for place in (500, 1001):
        assert sum(s <= place < s + pii.WINDOW for s in starts) == 2


def test_languages_of_texts_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = ~held_out(F.col("doc_id"))
    got = langid.identify(docs, learn=out).join(docs, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_codewords_differ():
    for count in (2, 4, 17, 60):
        code = langid.codewords(count)
        assert code.shape[0] == count and (np.abs(code.sum(axis=0)) < count).all()
        assert min(((code[i] != code[j]).sum() for i in range(count) for j in range(i)), default=9) >= (1 if count == 2 else 3)


def test_licenses_match_plain_search(spark, sf):
    import re

    docs = documents(spark, sf)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for doc_id, text in pairs(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(text or ""))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split()]
        row = got[doc_id]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert row["first_word"] == min((i for i, _ in places), default=None)
        assert row["last_word"] == max((i for i, _ in places), default=None)
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))


@pytest.mark.parametrize("notice", list(licenses.NOTICES))
def test_notices_are_found_with_as_many_edits_as_allowed(notice):
    dice = random.Random(notice)
    for trial in range(20):
        chars = list(notice)
        for place in sorted(dice.sample(range(1, len(notice) - 1), licenses.edits_allowed(notice)), reverse=True):
            if notice[place] != " ":
                chars[place] = dice.choice(["", "q", chars[place] + "z"])
        words = licenses.Words(b"some words, before " + "".join(chars).encode() + b" AND after.")
        found = [x for x in licenses.fuzzy_places(words) if x[2] == licenses.NOTICES[notice]]
        assert found and min(x[0] for x in found) <= 3 and max(x[1] for x in found) >= 3
    assert not licenses.fuzzy_places(licenses.Words(b"nothing of the kind stands in here at all"))


def test_notices_close_together_are_searched_in_proportion():
    import time

    start = time.perf_counter()
    for text in (b"all rights " * 10_000, b"cc by " * 20_000, b"license public general " * 5_000, b"permission to use " * 5_000):
        words = licenses.Words(text)
        assert len(licenses.phrase_places(words)) == text.count(b"cc by")
        licenses.fuzzy_places(words)
    assert time.perf_counter() - start < 30
    many = licenses.Words(b"all rights reserved. " * 300)
    assert {x[0] for x in licenses.fuzzy_places(many) if x[3] == 0} == set(range(0, 900, 3))


def test_many_spans_are_reconciled_in_order():
    import time

    text = "a@b.cd 5550109999 " * 20_000
    base = pii.base_spans(text)
    start = time.perf_counter()
    offered = [(0.95, (3, 18 * i + 7, 18 * i + 17)) for i in range(20_000)] + [(0.99, (0, 18 * i, 18 * i + 6)) for i in range(20_000)]
    assert len(pii.reconciled(base, offered, text)) == len(base) + 20_000 and time.perf_counter() - start < 5


def test_nearest_vectors_reach_the_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.nearest(vectors, lambda i: i % 20 == 0, shard=1500, query_block=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = []
    for query in ids[ids % 20 == 0]:
        scores = matrix @ matrix[np.searchsorted(ids, query)]
        best = [int(ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        found = sorted(got[query])
        assert [r[0] for r in found] == list(range(1, 21))
        assert all(abs(r[2] - scores[np.searchsorted(ids, r[1])]) < 1e-12 for r in found)
        hits.append(len({r[1] for r in found} & set(best)) / 20)
    assert np.mean(hits) >= 0.95


def test_windows_are_walked_and_few_rows_verified():
    rng = np.random.default_rng(3)
    given = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id")
    centres = rng.standard_normal((500, 64))
    for vectors, step in ((np.array(given["embedding"].to_pylist(), np.float64), 20),
                          (centres[rng.integers(0, 500, 50_000)] + 0.3 * rng.standard_normal((50_000, 64)), 2000)):
        ids, asked, hits, verified = np.arange(len(vectors)), np.arange(0, len(vectors), step), [], 0
        got = {query: [] for query in asked.tolist()}
        for start in range(0, len(ids), ann.SHARD):
            index = ann.CollisionIndex(vectors[start:start + ann.SHARD])
            for at, near, scores in index.nearest(ids[start:start + ann.SHARD], vectors[asked], asked, 20):
                got[int(asked[at])] += zip(-scores, near.tolist())
            verified += index.verified
        for query in asked.tolist():
            scores = vectors @ vectors[query]
            best = [int(i) for i in np.lexsort((ids, -scores)) if i != query][:20]
            hits.append(len({n for _, n in sorted(got[query])[:20]} & set(best)) / 20)
        assert np.mean(hits) >= 0.95 and verified < 0.2 * len(ids) * len(asked)


def test_nearest_of_ties_and_of_a_huge_group_of_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else rng.standard_normal(3).tolist(), "x") for i in range(900)]
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit(1))
    for r in ann.nearest(frame, lambda i: i % 60 == 0, shard=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    matrix, ids = np.array([r[1] for r in rows]), np.arange(900)
    for query, found in got.items():
        scores = np.einsum("ij,j->i", matrix, matrix[query])
        best = [int(i) for i in np.lexsort((ids, -scores)) if i != query][:20]
        assert [r[1] for r in sorted(found)] == best
    assert len(got) == 15


def test_nearest_leaves_out_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [inf, 1.0]),
            (7, [nan, 1.0]), (None, [9.0, 9.0]), (8, [9.0]), (9, []), (20, [-1.0, 0.0]), (40, [0.0, 0.0]), (1, [2.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, -1.0),
                                       (20, 1, 0, -1.0), (20, 2, 1, -2.0), (20, 3, 2, -2.0)]


def test_toxicity_finds_the_true_neighbours(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    dense = np.zeros((len(model.ids), len(model.vocabulary)))
    for row in range(len(model.ids)):
        part = slice(model.pointers[row], model.pointers[row + 1])
        dense[row, model.columns[part]] = model.values[part]
    assert len(model.ids) > 20
    for row in range(len(model.ids)):
        at = np.flatnonzero(dense[row])
        scores = dense @ dense[row]
        expected = [i for i in np.lexsort((np.arange(len(scores)), -scores.round(9))) if scores[i] > 1e-12][:7]
        rows, near = model.nearest(at, dense[row][at], 7)
        assert np.allclose(near, scores[expected]) and np.allclose(scores[rows], near)


def test_toxicity_of_texts_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity(docs, labels, usable=~held_out(F.col("doc_id"))).join(labels, "doc_id").filter(
        held_out(F.col("doc_id"))).collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)  # some labels are flipped
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert any(r["evidence"] for r in toxic)


def test_toxicity_compares_with_all_examples_over_all_their_words(spark):
    rng = random.Random(5)
    words = [f"w{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" vile" if i % 4 == 0 else ""), "en", "a") for i in range(80)]
    docs = spark.createDataFrame([*rows, (80, "12 34", "en", "a"), (81, "unheard", "en", "a")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert len(model.ids) == 60 and len(model.vocabulary) == len({w for r in rows[:60] for w in r[1].split()})
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(len(got[i]["evidence"]) == 5 for i in range(80))  # also of texts without a word that the label depends on
    assert got[80]["evidence"] == [] and got[80]["score"] == pytest.approx(0.25) and got[81]["evidence"] == []


def test_toxicity_of_copies_and_of_texts_with_one_header(spark):
    rng = random.Random(6)
    words = ["w" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    text = rng.choices(words[:100], k=60)
    copies = [" ".join(["own", *text[:i], "changed", *text[i + 1:]]) for i in range(40)]  # one toxic text, in near copies
    header = " ".join("h" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(60))
    headed = [header + " " + " ".join(rng.choices(words[100:], k=12)) + (" vile" if i % 2 else "") for i in range(120)]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(120)]
    texts = copies + headed + clean
    toxic = [1] * 40 + [i % 2 for i in range(120)] + [0] * 120
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").filter("doc_id % 4 < 2")
    model = toxicity.learn(docs, labels)
    vile = np.searchsorted(model.vocabulary, toxicity.hashed(toxicity.terms("vile"))[0])[0]
    changed = np.searchsorted(model.vocabulary, toxicity.hashed(toxicity.terms("own"))[0])[0]
    assert model.ratio[vile] > 1 and model.ratio[changed] == 0  # texts with one header count each, near copies as one
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [i for i in got if i % 4 >= 2 and got[i] != toxic[i]]
    assert len(wrong) <= 4 and not any(i < 40 for i in wrong)


@pytest.mark.parametrize("text, label, places", [
    ("foo relesed under the mit license or released under the mit license bar", "mit", [(1, 6, 1), (7, 12, 0)]),
    ("xx generl public licence and general public license yy", "gpl", [(1, 4, 2), (5, 8, 0)]),
    ("all rights reservd. all rigts reserved. all rights reserved.", "reserved", [(0, 3, 1), (3, 6, 1), (6, 9, 0)]),
    ("all rights reserved. all rigts reserved. all rights reservd.", "reserved", [(0, 3, 0), (3, 6, 1), (6, 9, 1)])])
def test_edited_notices_ahead_of_better_ones_are_found(text, label, places):
    found = licenses.fuzzy_places(licenses.Words(text.encode()))
    assert [(a, b, edits) for a, b, name, edits, _ in found if name == label] == places


def test_items_shorter_than_a_shingle_are_found_inside_documents(spark):
    filler = " ".join(f"filler{i}" for i in range(200))
    texts = [f"{filler} What is, it? {filler}", f"{filler} whatis it", "What is it", "is it", f"{filler} 漢字文。{filler}",
             f"{filler} 漢字文字", f"it {filler} one two three four five six", None, ""]
    items = [(1, "what is it"), (2, "漢字文"), (3, "IT"), (4, "two three four five"), (5, "one two three four five six"),
             (6, "two four"), (7, None), (8, "!")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], DOCS)
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [
        (0, 1), (0, 3), (1, 3), (2, 1), (2, 3), (3, 3), (4, 2), (6, 3), (6, 4), (6, 5)]
    assert all(r["containment"] == 1.0 for r in got)
    assert {r["item_shingles"] for r in got if r["item_id"] != 5} == {1}
