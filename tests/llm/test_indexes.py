"""Suffix arrays, conversation tries and vector codes against plain Python, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import prefixtrie, suffixindex, vectorcodes


def repeated(texts, length):
    """Spans covered by strings that start anywhere else too."""
    starts = defaultdict(int)
    for text in texts:
        for i in range(len(text) - length + 1):
            starts[text[i:i + length]] += 1
    return [suffixindex.merged_spans([(i, i + length) for i in range(len(text) - length + 1) if starts[text[i:i + length]] > 1])
            for text in texts]


def passages(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(50, 300))) for _ in range(20)]
    out = [None, "", "a" * 100, "a" * 21, "ab" * 50, "x" * 39]
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(base)
            start = rng.randrange(len(part))
            text += part[start:rng.randrange(start, len(part))] + rng.choice(["", "x", "qq", ""])
        out.append(text)
    return out


@pytest.mark.parametrize("length, limit, batches", [(40, 512, 4), (21, 3, 3)])
def test_passages_match_plain_python(spark, length, limit, batches):
    texts = passages(length, 120)
    texts += texts[-3:]  # exact copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixindex.dedup_passages(docs, length=length, limit=limit, batches=batches).collect()}
    plain = [(t or "").encode() for t in texts]
    for i, (text, spans) in enumerate(zip(plain, repeated(plain, length))):
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == spans
        kept, at = b"", 0
        for start, end in spans:
            kept, at = kept + text[at:start], end
        assert bytes(got[i]["kept"]) == kept + text[at:]
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (
            len(text), sum(b - a for a, b in spans), len(spans))


def test_equal_strings_choose_the_same_place():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc ") for _ in range(900))
    for text in (text, b"z" * 700, b"ab" * 400):
        place = {}
        for at, first, last in suffixindex.chosen_places(text, 60):
            for start in range(first, last + 1):
                assert start <= at <= start + 60 - suffixindex.head_size(60)
                assert place.setdefault(text[start:start + 60], at - start) == at - start
        assert sum(last - first + 1 for _, first, last in suffixindex.chosen_places(text, 60)) == len(text) - 59


def test_places_are_few_and_long_texts_are_cut_up(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 200_000).astype(np.uint8).tobytes()
    whole = list(suffixindex.chosen_places(text))
    assert len(whole) < len(text) / 130
    monkeypatch.setattr(suffixindex, "STEP", 7000)
    suffixindex._powers.cache_clear()
    parts = list(suffixindex.chosen_places(text))
    assert {p for p, _, _ in parts} == {p for p, _, _ in whole} and len(parts) <= len(whole) + 30
    suffixindex._powers.cache_clear()


def test_arrays_are_merged_geometrically(spark):
    texts = passages(9, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = suffixindex.entries(docs, length=40, batches=7).cache()
    family, sizes = suffixindex.Family(spark), []
    for number in range(7):
        family.add(held.filter(F.col("batch") == number))
        sizes.append([size for size, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1]]
    stored = [spark.read.parquet(path) for _, path in family.levels]
    assert sum(a.agg(F.sum("n")).first()[0] for a in stored) == held.agg(F.sum("n")).first()[0]
    held.unpersist()


def test_a_hot_passage_is_halved_into_small_groups(spark):
    """Many different contexts around one passage that is too short to be removed, and around one that is not."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, long_ = word(30), word(45)
    texts = [word(60) + (short if i % 2 else long_) + word(60) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixindex.dedup_passages(docs, length=40, limit=16).collect()}
    assert [got[i] for i in range(300)] == repeated([t.encode() for t in texts], 40)


def test_passages_of_odd_tables(spark):
    rows = [(1, "same " * 100, "k"), (1, "same " * 100, None), (None, "Ω" * 300, "k"), (2, None, "k"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for name in ("name", "kept", "n_removed", "start", "batch", "digest", "suffix"):
        docs = docs.withColumn(name, F.lit(name))
    got = suffixindex.dedup_passages(docs)
    assert set(docs.columns) < set(got.columns) and dict(got.dtypes)["kept"] == "binary"
    rows = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["name"]) for r in got.collect())
    assert rows == [("1", 500, 500, 1, b"", "name"), ("1", 500, 500, 1, b"", "name"), ("2", 0, 0, 0, b"", "name"),
                    ("3", 0, 0, 0, b"", "name"), ("None", 600, 600, 1, b"", "name")]
    assert suffixindex.dedup_passages(docs.limit(0)).count() == 0


def trie(rows):
    """rows: (conv_id, turn, role, text); gives {(smallest member, depth): the rest}."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h]) + tuple(mine[h:])
        for d in range(len(full) + 1):
            nodes[full[:d]].append((c, d == len(full)))
    out = {}
    for seq, held in nodes.items():
        below = [s for s in nodes if s[:len(seq)] == seq]
        ends = sorted(c for c, end in held if end)
        parent = min(c for c, _ in nodes[seq[:-1]]) if seq else None
        out[min(c for c, _ in held), len(seq)] = (
            parent, len(held), sum(len(s) == len(seq) + 1 for s in below),
            sum(not any(t[:-1] == s for t in nodes if t) for s in below),
            sum((len(nodes[s]) - 1) * len(s[-1][1].split()) for s in below if s),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def found_nodes(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                                         r["ends_sha256"]) for r in df.collect()}


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_matches_plain_python(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi there", "a b c", "", None, "x"]))
            for c in [*range(0, 70), -7, -20, -33, 145] for t in range(rng.randrange(1, 6))]
    rows += [(200, None, "user", "late"), (200, 3, "bot", "x"), (200, 3, "bot", "x"), (None, 0, "user", "nobody"), (345, 0, "user", "only")]
    got = found_nodes(prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)))
    assert got == trie(rows)


def test_trie_over_many_tasks_and_deep_chains(spark, monkeypatch):
    """Equal long conversations that each fill several tasks, and many that end in one node."""
    rows = [(c, t, "user", f"turn {t}") for c in (0, 40, 80) for t in range(70)]
    rows += [(c, 0, "user", "same") for c in range(1000, 1200)]
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    try:
        assert found_nodes(prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS))) == trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def test_fingerprints_compose():
    powers = prefixtrie.Powers(prefixtrie.base_of(0))
    turns = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    value = lambda part: reduce(
        lambda v, t: (v * powers.base + prefixtrie.turn_value(t)) % prefixtrie.P, part, 0)
    for cut in range(10):
        head, tail = value(turns[:cut]), value(turns[cut:])
        assert prefixtrie.compose(head, tail, 9 - cut, powers) == value(turns)
        assert prefixtrie.divided(value(turns), head, 9 - cut, powers) == tail
    assert prefixtrie.parent_value(value(turns), turns[-1], pow(powers.base, -1, prefixtrie.P)) == value(turns[:-1])


def test_a_collision_is_noticed_and_made_anew(spark, monkeypatch):
    rows = [(c, t, "user", f"{c} {t}") for c in range(5) for t in range(3)]
    plain, tried = prefixtrie.base_of, []

    def weak(seed):
        tried.append(seed)
        return plain(seed)

    monkeypatch.setattr(prefixtrie, "base_of", weak)
    conversations = spark.createDataFrame(rows, TURNS)
    real = prefixtrie.members
    monkeypatch.setattr(prefixtrie, "members", lambda own, base, steps: real(own, base, steps).withColumn(
        "value", F.when(F.col("depth") == 1, F.lit(b"\x01" * 16)).otherwise(F.col("value"))) if len(tried) == 1 else real(own, base, steps))
    assert found_nodes(prefixtrie.prefix_trie(conversations)) == trie(rows) and tried == [0, 1]


def test_trie_of_odd_tables(spark):
    frame = spark.createDataFrame([], TURNS)
    assert prefixtrie.prefix_trie(frame).count() == 0
    rows = [(1, 0, "user", "x " * 50_000), (1, 1, None, None)]
    wide = spark.createDataFrame(rows, TURNS)
    for name in ("conv", "pos", "value", "words", "depth", "n", "parent", "place"):
        wide = wide.withColumn(name, F.lit(name))
    assert found_nodes(prefixtrie.prefix_trie(wide)) == trie(rows)


def coded(vectors, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks by full search; vectors are rows of integers."""
    x = np.array(vectors)
    split = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in split]

    def nearest(p, book):
        distance = ((p[:, None] - book[None]) ** 2).sum(2)
        return distance.argmin(1), distance.min(1)

    for _ in range(rounds):
        for number, p in enumerate(split):
            found, _ = nearest(p, books[number])
            for e in set(found):
                books[number][e] = p[found == e].sum(0) // (found == e).sum()
    both = [nearest(p, book) for p, book in zip(split, books)]
    return ["".join(f"{f[i]:02x}" for f, _ in both) for i in range(len(x))], sum(d for _, d in both), books


def test_codes_match_full_search(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, (700, 16)), np.repeat(rng.normal(0, 0.2, (1, 16)), 300, axis=0)]).astype(np.float32)
    label = [None if i % 7 == 0 else int(i % 3) for i in range(1000)]
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], label[i]) for i in range(1000)],
                                  "vec_id long, embedding array<float>, label int").repartition(7)
    got, books = vectorcodes.compress(frame, entries=64)
    codes, errors, expected = coded(np.floor(x.astype(np.float64) * 1024).astype(np.int64), entries=64)
    assert all((a == b).all() for a, b in zip(books, expected))
    sums = defaultdict(int)
    for i, error in enumerate(errors):
        sums[label[i]] += int(error)
    rows = {r["vec_id"]: r for r in got.collect()}
    for i in range(1000):
        assert (rows[i]["code"], rows[i]["error"], rows[i]["label_error"]) == (codes[i], errors[i], sums[label[i]])
    assert len(vectorcodes.digest(books)) == 64


def test_cells_keep_few_entries_and_lose_none():
    rng = np.random.default_rng(1)
    book = np.floor(rng.normal(0, 128, (256, 16))).astype(np.int64)
    book[7] = book[3]  # a tie goes to the lower index
    values = np.concatenate([np.floor(rng.normal(0, 128, (500, 16))).astype(np.int64), book[[7] * 5]])
    cells = vectorcodes.Cells(book)
    for _ in range(2):
        found, distance = cells.nearest(values)
        full = ((values[:, None] - book[None]) ** 2).sum(2)
        assert (found == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert cells.exact < 0.15 * 256 * cells.asked and len(cells.known) <= 505
    small = vectorcodes.Cells(book, known=50)
    assert (small.nearest(values)[0] == found).all()


def test_codes_of_odd_tables(spark):
    ddl = "vec_id long, embedding array<double>, label int, code string, vector int"
    rows = [(1, [0.5, 0.5, 1.0, -0.0001, 2.0], 1, "c", 0), (1, [0.25, 0.5, 1.0, 0.0, 2.0], None, "c", 0), (None, [0.5] * 5, None, "c", 0),
            (2, None, 1, None, 0), (3, [0.5, None, 1.0, 1.0, 1.0], 1, "c", 0), (4, [float("nan")] * 5, 1, "c", 0),
            (5, [float("inf")] * 5, 1, "c", 0), (6, [], 1, "c", 0), (7, [0.5, 0.5], 1, "c", 0), (8, [1e300, -1e300, 0.0, 0.0, 0.0], 2, "c", 0)]
    got, books = vectorcodes.compress(spark.createDataFrame(rows, ddl))
    out = {(r["vec_id"], r["code"]) for r in got.collect()}
    assert {i for i, _ in out} == {1, None, 8} and got.count() == 4 and len(books) == 4
    assert {r["error"] for r in got.collect()} == {0} and {r["label_error"] for r in got.collect()} == {0}
    none, books = vectorcodes.compress(spark.createDataFrame([], ddl))
    assert none.count() == 0 and books == [] and vectorcodes.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="1 to 256"):
        vectorcodes.compress(none, entries=300)
