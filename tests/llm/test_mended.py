"""Spans that window edges cut, positions behind characters beyond ASCII, many languages, hot branches, bounded learning."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid, licenses, neardup, pii, toxicity


class Perfect:
    """A tagger that knows where the one span of the text is."""

    def __init__(self, text, span):
        self.codes, self.span = pii.encode(text), span

    def decode(self, codes):
        tags = []
        starts = pii.window_starts(self.codes)
        for start in starts:
            tags.append(pii._tags([self.span], int(start)))
        return np.array(tags), np.ones((len(tags), pii.WINDOW))


@pytest.mark.parametrize("size", [18, 47, 60, 95, 140, 200])
def test_no_span_is_lost_at_a_window_edge(size):
    for offset in range(0, 2 * pii.WINDOW, 3):
        text = "x" * offset + "a1" * (size // 2) + "x" * (400 - offset)
        span = (4, offset, offset + 2 * (size // 2))
        parts = pii.all_spans([text], Perfect(text, span))[0]
        assert parts == ([], [span]), (offset, parts)


def test_two_cut_spans_side_by_side_stay_two():
    text = "x" * 40 + "b2" * 30 + " " + "c3" * 30 + "x" * 200
    spans = [(4, 40, 100), (4, 101, 161)]

    class Both:
        def decode(self, codes):
            tags = [pii._tags(spans, int(s)) for s in pii.window_starts(pii.encode(text))]
            return np.array(tags), np.ones((len(tags), pii.WINDOW))

    assert pii.all_spans([text], Both())[0][1] == spans


def test_the_tagger_adds_phones_as_it_learns_them_only():
    for number, added in (("5550109999", False), ("0550109999", True), ("(555) 010 9999", True)):
        text = "call " + number + " now"
        span = (3, 5, 5 + len(number))
        assert pii.reconciled([], [(0.99, span)], text) == [span]
        assert pii.all_spans([text], Perfect(text, span)) == [([], [span] if added else [])]


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.fresh()
    tagger.weights["moves"] = rng.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    codes = rng.integers(0, pii.SYMBOLS, (3, 4)).astype(np.uint8)
    tags, _ = tagger.decode(codes)
    scores = tagger.scores(codes)
    for row in range(3):
        value = lambda path: sum(scores[i, row, t] for i, t in enumerate(path)) + sum(
            tagger.weights["moves"][a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=value)
        assert value(tuple(tags[row])) == pytest.approx(value(best), abs=1e-4)


def test_the_tagger_adds_what_no_base_pattern_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = pii.find_personal_data(docs).join(docs, "doc_id").collect()
    wanted = {(r["doc_id"], s) for r in rows for s in pii.labelled_spans(r["text"] or "") if s[0] == 4}
    found = {(r["doc_id"], (pii.KINDS.index(s["kind"]), s["start"], s["end"])) for r in rows for s in r["spans"] if s not in r["base"]}
    assert len(wanted) > 100 and len(found & wanted) >= 0.9 * len(wanted)
    assert len(found - wanted) <= 0.1 * len(found), sorted(found - wanted)[:5]
    texts = ["write to anna.berg@m\u00fcller-haus.example.com today", "card 4111.1111.1111.1111 charged", "nothing 12 here"]
    assert [len(pii.labelled_spans(pii.altered(t, pii.base_spans(t)))) <= len(pii.base_spans(t)) for t in texts] == [True] * 3


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("ahead", ["", "\u6f22\u5b57 ", "\u5b57 " * 3, "\u00e9t\u00e9 \u6f22\u5b57\u6f22 \U0001F600 ", "\u00fc" * 40 + " "])
def test_notices_behind_characters_beyond_ascii(ahead):
    first = len(licenses.normal_words(ahead.encode()))
    words = licenses.Words((ahead + "all rights reservd \u6f22\u5b57").encode())
    assert [(p[0], p[1], p[2], p[3]) for p in licenses.fuzzy_places(words)] == [(first, first + 3, "reserved", 1)]


def test_notices_match_an_edit_distance_search():
    rng = random.Random(7)
    for _ in range(60):
        notice = rng.choice(sorted(licenses.NOTICES))
        letters = list(notice)
        for _ in range(rng.randrange(0, licenses.edits_allowed(notice) + 1)):
            at = rng.randrange(1, len(letters) - 1)
            if letters[at] != " ":
                letters[at] = rng.choice(["", "x", "\u00e9", letters[at] + "q"])
        changed = "".join(letters)
        ahead = " ".join(rng.choice(["\u6f22", "ab", "\u00e9", "w"]) for _ in range(rng.randrange(5)))
        words = licenses.Words(f"{ahead} {changed} zz".encode())
        first, size = len(ahead.split()), len(changed.split())
        distance = edit_distance(notice, changed)
        if distance <= licenses.edits_allowed(notice):
            found = [p for p in licenses.fuzzy_places(words) if p[2] == licenses.NOTICES[notice] and p[3] <= distance]
            assert any(abs(p[0] - first) <= 1 and abs(p[1] - first - size) <= 1 for p in found), (notice, changed, ahead)


def test_more_languages_than_a_task_holds(spark):
    rng = random.Random(1)
    langs = {f"l{i:03d}": [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4))) for _ in range(6)] for i in range(600)}
    rows = [(i * 10 + j, " ".join(rng.choices(words, k=30)), lang) for i, (lang, words) in enumerate(langs.items()) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, learn=F.col("doc_id") % 10 < 2).collect()}
    held = [(got[d], lang) for d, _, lang in rows if d % 10 == 2]
    assert len({pred for pred, _ in held}) > 550 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_margins_match_plain_counting(spark):
    rows = [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, "der hund bellt", "de"), (4, "the dog ran", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("lang"), F.col("text"), F.lit(True))
    shares = []
    for lang in model.languages:
        counts = np.full(langid.FEATURES, 0.5)
        for _, text, of in rows:
            if of == lang:
                for part in langid.grams(text.encode()):
                    np.add.at(counts, part, 1)
        shares.append(counts / counts.sum())
    for bit in range(model.code.shape[1]):
        side = {sign: np.mean([s for s, c in zip(shares, model.code[:, bit]) if c == sign], axis=0) for sign in (1, -1)}
        plain = np.log(side[1]) - np.log(side[-1])
        plain /= np.abs([c * (s @ plain) for s, c in zip(shares, model.code[:, bit])]).mean()
        assert np.allclose(model.weights[:, bit], plain, rtol=1e-3, atol=1e-4)
    assert [model.predict(t.encode())[0] for _, t, _ in rows] == [lang for _, _, lang in rows]


def test_a_large_branch_is_dealt_by_its_outsiders(spark, monkeypatch):
    """A branch of 20,000 nodes of one component and one stranger is not multiplied."""
    rows = spark.range(20_001).select(
        F.lit(0).alias("tree"), F.lit(0).cast("long").alias("path"), F.col("id").cast("string").cast("binary").alias("node"),
        F.when(F.col("id") == 7, F.lit(b"b")).otherwise(F.lit(b"a")).alias("root"), F.lit(10).cast("long").alias("size"),
        F.lit(b"s").alias("signature"), F.lit(20_001).cast("long").alias("members"), F.lit(b"a").alias("largest"),
        F.lit(1).cast("long").alias("outsiders"))

    class Frame:
        least, ratio = 1, 0.8

    monkeypatch.setattr(neardup, "_promising", lambda *_: lambda batches: batches)
    dealt = neardup._Join.promising(Frame(), rows)
    assert dealt.count() < 2 * 20_001
    groups = dealt.groupBy("low", "high").agg(F.count("*").alias("n"), F.count_distinct("root").alias("roots")).collect()
    assert max(r["n"] for r in groups) < 3 * neardup.BLOCK and all(r["roots"] == 2 or r["low"] == r["high"] for r in groups)


def test_learning_is_bounded_in_words_and_visits_few_blocks(spark):
    rng = random.Random(3)
    words = {lang: [lang + "".join(rng.choices("abcdefgh", k=4)) for _ in range(300)] for lang in "xyz"}
    rows = [(i, " ".join(rng.choices(words["xyz"[i % 3]], k=60)) + (" vile" if i % 5 == 0 else "")) for i in range(900)]
    rows.append((900, " ".join(f"w{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    small = toxicity.learn(docs.unionByName(docs), labels, max_entries=5000)
    assert 0 < len(small.values) <= 5000 and len(small.ids) < 100
    model = toxicity.learn(docs.filter("doc_id < 900"), labels)
    asked, full = [model.weigh(toxicity.terms(text)) for _, text in rows[:60]], np.zeros(len(model.vocabulary))
    model.visited = 0
    for at, weight in asked:
        found, scores = model.nearest(at, weight, 10)
        full[at] = weight
        every = model.cosines(full, 0, len(model.ids))
        full[at] = 0
        assert np.allclose(scores, np.sort(every)[::-1][:10])
    assert model.visited < 0.7 * len(asked) * -(-len(model.ids) // toxicity.BLOCK)


def test_plain_words_are_those_of_the_pattern():
    plain = "".join(map(chr, range(128))) + " It's a_b c3d\x1cx\x0by -e- K\u212a"
    for text in (plain[:-1], plain, "Stra\u00dfe_2 \u00c9t\u00e9\u00a0x\u00b2"):
        assert toxicity.words(text) == toxicity.LETTERS.findall(text.lower())


def test_neighbours_of_some_texts_at_a_time_are_those_of_all_examples(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(1500)]
    rows = [(i, " ".join(rng.choices(words, k=50)) + (" vile" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    asked = [model.weigh(toxicity.terms(text)) for text in [text for _, text in rows[:40]] + ["", "zz"]]
    full = np.zeros(len(model.vocabulary))

    def check(k: int) -> list:
        got = model.nearest_of(asked, k, [*range(40), -1, -1])
        for number, ((at, weight), (found, scores)) in enumerate(zip(asked, got)):
            full[at] = weight
            every = model.cosines(full, 0, len(model.ids)) if len(model.ids) else np.zeros(0)
            full[at] = 0
            every[number if number < 40 else []] = 0
            assert np.allclose(scores, np.sort(every[every > 0])[::-1][:k]) and np.allclose(every[found], scores)
        return got

    together = check(10)
    check(500)
    monkeypatch.setattr(toxicity, "POSTINGS", 500)  # halved until little is read in one go
    monkeypatch.setattr(toxicity, "PARTS", 100)
    for (one, near), (other, alike) in zip(together, check(10)):
        assert np.array_equal(one, other) and np.array_equal(near, alike)
    model.made = None
    monkeypatch.setattr(toxicity, "COMMON", 2000)  # no word is left for the postings
    check(10)


def test_small_steps_are_few_files_and_remembered_words_are_few(spark, monkeypatch):
    from tidewater.llm import common

    stored, write = {}, toxicity.written

    def counting(session, df, path):
        out = write(session, df, path)
        stored[path.rsplit("/", 1)[1].rsplit("-", 1)[0]] = len(out.inputFiles())
        return out

    rows = [(i, f"word{i % 7} and more of the words in {i}" + (" vile" if i % 5 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for module in (toxicity, neardup):
        monkeypatch.setattr(module, "written", counting)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        toxicity.learn(docs, labels)
        neardup.near_duplicates(docs).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert stored["examples"] <= cores and stored["nodes"] <= cores
    hashes = common.WordHashes()
    assert max(len(hashes) for i in range(140_000) if hashes[str(i).encode()]) <= 1 << 16
    assert len(hashes) <= 1 << 16 and toxicity.KNOWN <= 4096
