"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all words, by a block-max inverted index.

Examples are labelled rows, the first in the order of a seeded hash of their ids, at most `max_examples` of them and
`max_entries` different words in them together; every one with any word is in the index, with all its words. A word is
known by a 64-bit hash. Document frequencies are those of all documents. Words that no example holds count in a
text's length, as rare as words of one document.

The index lies in blocks of BLOCK examples, similar ones together (by the pivot they are most alike, so languages and
topics have their own blocks). The COMMON words of the most examples have a matrix of weights per block, and per word and
block the largest weight there; the others have postings. What a text shares with each example of the other words,
the largest such sum in a block, and the text's weights times the largest of the common words there bound the block from
above. Blocks are visited by falling bound, some texts at a time, until no bound reaches the k-th best cosine; the
cosines of those that may be among the best are computed in double precision. So the neighbours are those of a
comparison with all examples.

Neighbours vote with what 1 / (distance + SOFT) has above a neighbour without any common word. A logistic
curve fitted to all examples' own votes, each without itself, makes a score of the vote. It weighs votes of
far and of close neighbours apart, and knows how many words there are and the sum and the largest of the log
ratios of the words whose presence depends on the label (by a log-likelihood ratio that chance alone would
hardly give one of all words, `max_terms` at most). These are features of the curve only. For an example they
are taken without the example's group.
Examples that cosines of ALIKE or more link are a group, and each has one part of the group's weight in
the choice of those words and in the curve, as copies of one toxic text would make all its words look toxic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import LETTERS, WordHashes, prepare_python, quoted
from tidewater.session import discard, scratch_path, written

MAX_EXAMPLES = 3072
MAX_ENTRIES = 1_500_000
MAX_TERMS = 8192
MIN_EXAMPLES_OF_TERM = 3
NEIGHBOURS = 64
BLOCK = 64
PIVOTS = 64
COMMON = 512
AT_ONCE = 8
SOFT = 0.05
KNOWN = 4096
POSTINGS = 1 << 20  # read in one go
PARTS = 1 << 20  # shares of words and examples added up in one go
BATCH = 64
ROWS_PER_TASK = 250
ALIKE = 0.9
SLICE = 8192
START = (0.0, 1.0, 1.0, 0.0, 0.0, 0.0)

_HASHES = WordHashes()
_BLANKED = {code: " " for code in range(128) if not LETTERS.match(chr(code))}
_POSTING = np.dtype([("row", np.int32), ("weight", np.float32)])


def words(text: str) -> list[str]:
    """The text's words in lower case; plain ASCII is split, which finds the same words as the pattern."""
    text = text.lower()
    return text.translate(_BLANKED).split() if text.isascii() else LETTERS.findall(text)


def terms(text: str | None) -> Counter:
    """How often each word stands in the text, in lower case."""
    return Counter(words(text)) if text else Counter()


def hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, ascending, and how often each stands there."""
    keys = np.fromiter(map(_HASHES.__getitem__, counts), np.uint64, len(counts))
    order = np.argsort(keys)
    return keys[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other."""
    sizes = ends - starts
    out = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    out += np.arange(len(out))
    return out


@dataclass
class Examples:
    """The examples with any word, by id, and their weights of length 1."""

    vocabulary: np.ndarray  # hashes of all words of all examples, ascending
    idf: np.ndarray
    rarest: float  # the idf of a word of one document
    ids: list[str]
    labels: np.ndarray
    pointers: np.ndarray  # of each row's entries
    columns: np.ndarray
    values: np.ndarray
    none_rate: float  # toxic share of the examples without any word
    base_rate: float
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the words that depend on the label, else 0
    curve: tuple[float, ...] = START
    known: dict[bytes, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    made: tuple | None = None
    visited: int = 0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "made": None}

    def parts(self) -> Iterator[tuple[slice, slice]]:
        """Some rows at a time, and their entries."""
        for start in range(0, len(self.ids), ROWS_PER_TASK):
            end = min(start + ROWS_PER_TASK, len(self.ids))
            yield slice(start, end), slice(int(self.pointers[start]), int(self.pointers[end]))

    def _index(self) -> tuple:
        """The words of the most examples, each word's column in a matrix of such words or -1; the matrix, a row per
        example; its largest weight by word and block; where each other word's postings begin; these, row and weight
        side by side, as they are read together."""
        if self.made is None:
            blocks, count = -(-len(self.ids) // BLOCK), len(self.vocabulary)
            common = np.argsort(-np.bincount(self.columns, minlength=count), kind="stable")[:COMMON]
            place = np.full(count, -1, np.int32)
            place[common] = np.arange(len(common))
            row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.pointers))
            at = place[self.columns]
            matrix, held = np.zeros((blocks * BLOCK, len(common)), np.float32), at >= 0
            matrix[row[held], at[held]] = self.values[held]
            others = np.flatnonzero(~held)
            others = others[np.argsort(self.columns[others], kind="stable")]
            postings = np.empty(len(others), _POSTING)
            postings["row"], postings["weight"] = row[others], self.values[others]
            self.made = (place, matrix, matrix.reshape(blocks, BLOCK, -1).max(axis=1).T.astype(float),
                         np.searchsorted(self.columns[others], np.arange(count + 1)), postings.view(np.int64))
        return self.made

    def weigh(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The text's words that any example holds, and their weights; with all other words their length is 1."""
        if not counts or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        keys, often = hashed(counts)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        held = self.vocabulary[at] == keys
        weight = (1 + np.log(often)) * np.where(held, self.idf[at], self.rarest)
        return at[held], weight[held] / math.sqrt(float(weight @ weight))

    def cosines(self, query: np.ndarray, first: int, last: int) -> np.ndarray:
        """The cosines of the rows from first to last with a query, given as weights of the whole vocabulary."""
        part = slice(int(self.pointers[first]), int(self.pointers[last]))
        return np.add.reduceat(self.values[part] * query[self.columns[part]], self.pointers[first:last] - part.start)

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, ties to earlier rows, and their cosines, but for one row."""
        return self.nearest_of([(at, weight)], k, [without])[0]

    def nearest_of(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int,
                   without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` for some texts at a time. A block is visited by all texts it may hold neighbours of, in single
        precision; what may be among the k best by that is computed again in double precision, word by word."""
        if not self.ids or not asked:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        place, matrix, most, starts, held = self._index()
        blocks, words_ = len(matrix) // BLOCK, np.concatenate([at for at, _ in asked])
        weights, text = np.concatenate([w for _, w in asked]), np.repeat(np.arange(len(asked)), [len(at) for at, _ in asked])
        column, common = place[words_], np.zeros((len(asked), matrix.shape[1]))
        dense, sparse = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        common[text[dense], column[dense]] = weights[dense]
        begin, end = starts[words_[sparse]], starts[words_[sparse] + 1]
        if len(asked) > 1 and int((end - begin).sum()) > POSTINGS:
            half, without = len(asked) // 2, without or [-1] * len(asked)
            return self.nearest_of(asked[:half], k, without[:half]) + self.nearest_of(asked[half:], k, without[half:])
        postings = held[_spread(begin, end)].view(_POSTING)
        shares = np.repeat(weights[sparse], end - begin)
        shares *= postings["weight"]
        into = np.repeat(text[sparse] * len(matrix), end - begin)
        into += postings["row"]
        sums = np.bincount(into, shares, len(asked) * len(matrix)).astype(float).reshape(len(asked), blocks, BLOCK)
        for number, row in enumerate(without or ()):
            if row >= 0:
                sums[number, row // BLOCK, row % BLOCK] = -np.inf
        bounds = (sums.max(axis=2) + common @ most) * (1 + 1e-9)
        falling = np.argsort(-bounds, axis=1, kind="stable")
        slack = 2 * (matrix.shape[1] + 4) * 2.0 ** -23 + 1e-9  # twice what single precision may be wrong by
        scores, single = np.full(sums.shape, -1.0), common.astype(np.float32)
        top, least = np.full((len(asked), k), -1.0), np.zeros(len(asked))
        for start in range(0, blocks, AT_ONCE):
            part = falling[:, start:start + AT_ONCE]
            number, turn = np.nonzero(np.take_along_axis(bounds, part, 1) > np.maximum(least - slack, 0)[:, None])
            if not len(number):
                break
            self.visited += len(number)
            block = part[number, turn]
            order = np.argsort(block, kind="stable")
            for who in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                one = block[who[0]]
                scores[number[who], one] = sums[number[who], one] + single[number[who]] @ matrix[one * BLOCK:(one + 1) * BLOCK].T
            new = np.take_along_axis(scores, part[:, :, None], 1).reshape(len(asked), -1)
            top = np.partition(np.append(top, new, axis=1), new.shape[1], axis=1)[:, new.shape[1]:]
            least = np.maximum(top[:, 0], 0)
        out, among, counts = [], np.full(len(matrix), -1), np.zeros(len(words_) + 1, np.int64)
        counts[1:][sparse] = end - begin
        counts, firsts = np.cumsum(counts), np.searchsorted(text, np.arange(len(asked) + 1))
        for number, enough in enumerate(least - slack):
            rows = np.flatnonzero(scores[number].ravel() > max(enough, 0))
            first, last = firsts[number], firsts[number + 1]
            among[rows], exact = np.arange(len(rows)), np.zeros(max(len(rows), 2))  # two columns are summed word after word
            step = max(PARTS // len(exact), 1)
            for low in range(first, last, step):
                high = min(low + step, last)
                mine, own = column[low:high], slice(counts[low], counts[high])
                parts, known = np.zeros((high - low + 1, len(exact))), np.flatnonzero(mine >= 0)
                parts[0] = exact
                parts[known + 1, :len(rows)] = matrix[rows[:, None], mine[known]].T * weights[low:high][known, None]
                which = among[postings["row"][own]]
                good = np.flatnonzero(which >= 0)
                word = np.repeat(np.arange(1, high - low + 1), np.diff(counts[low:high + 1]))
                parts[word[good], which[good]] = shares[own][good]
                exact = parts.sum(axis=0)
            among[rows], exact = -1, exact[:len(rows)]
            best = np.lexsort((rows, -exact.round(12)))[:k]
            out.append((rows[best], exact[best]))
        return out

    def vote(self, rows: np.ndarray, scores: np.ndarray) -> float:
        """The neighbours' weighted share of toxic ones, with the base rate as one far neighbour."""
        weight = 1 / (np.maximum(1 - scores, 0) + SOFT) - 1 / (1 + SOFT)
        return float((weight @ self.labels[rows] + self.base_rate) / (weight.sum() + 1))

    def signs(self, rows: np.ndarray, scores: np.ndarray, ratio: float, strongest: float, words: int) -> list[float]:
        """What the calibration knows of a text."""
        share = min(max(self.vote(rows, scores), 1e-6), 1 - 1e-6)
        close = min(float(scores[0]), 1.0) ** 4 if len(scores) else 0.0
        odds = math.log(share / (1 - share))
        return [1.0, odds * (1 - close), odds * close, ratio, strongest, math.log(words)]

    def scores(self, values: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray, bool]]:
        """Every text's score, nearest examples, their cosines, and whether anything of its own speaks for toxic:
        words whose presence depends on the label, or neighbours that are toxic more often than examples are. Where
        fewer than half of the examples are toxic, a score of 0.5 says so by itself.
        """
        out = []
        for start in range(0, len(values), BATCH):
            counts = [terms(value) for value in values[start:start + BATCH]]
            asked = [self.weigh(c) for c in counts]
            keys = [xxhash.xxh3_128_digest(at.tobytes() + weight.tobytes()) for at, weight in asked]
            new = {key: q for key, q in zip(keys, asked) if key not in self.known} if self.ids else {}
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = dict(zip(keys, asked))
            self.known.update(zip(new, self.nearest_of(list(new.values()), NEIGHBOURS)))
            for key, c, (at, _) in zip(keys, counts, asked):
                if not c or not self.ids:
                    out.append((self.none_rate, np.zeros(0, np.int64), np.zeros(0), False))
                    continue
                rows, near = self.known[key]
                ratio, strongest = float(self.ratio[at].sum()), float(self.ratio[at].max(initial=0.0))
                odds = np.dot(self.curve, self.signs(rows, near, ratio, strongest, len(c)))
                out.append((float(1 / (1 + math.exp(-np.clip(odds, -30, 30)))), rows, near,
                            self.base_rate < 0.5 or ratio > 0 or self.vote(rows, near) > self.base_rate))
        return out

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray, bool]:
        return self.scores([text])[0]


def _fitted_curve(signs: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """The logistic curve that best maps signs to labels, with a weak pull to the bare vote (Newton's method)."""
    start = np.array(START)
    curve, x = start.copy(), signs.T

    def loss(c: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, c @ x) - labels * (c @ x)) + 0.05 * ((c - start) @ (c - start)))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(curve @ x, -700, 700)))
        slope = x @ (weight * (labels - p)) - 0.1 * (curve - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 0.1 * np.eye(len(start)), slope)
        while loss(curve + step) > loss(curve) and np.abs(step).max() >= 1e-9:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        curve = curve + step
    return tuple(float(c) for c in curve)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words."""
    for batch in batches:
        found = [hashed(terms(text)) for text in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1),
                               *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))],
                              names=["id", "toxic", "hashes", "counts"])


def _ratio(clean: np.ndarray, toxic: np.ndarray, cleans: float, toxics: float) -> np.ndarray:
    """The log-likelihood ratio of a term's presence and the label."""
    total = cleans + toxics

    def part(seen: np.ndarray, row: np.ndarray, column: float) -> np.ndarray:
        seen = np.maximum(seen, 0)
        return seen * np.log(np.where(seen > 0, seen * total / np.maximum(row * column, 1e-300), 1.0))

    present, absent = clean + toxic, total - clean - toxic
    return 2 * (part(clean, present, cleans) + part(toxic, present, toxics)
                + part(cleans - clean, absent, cleans) + part(toxics - toxic, absent, toxics))


def _log_ratio(clean: np.ndarray, toxic: np.ndarray, cleans: float, toxics: float) -> np.ndarray:
    """How much more often toxic examples hold a term than clean ones, as a smoothed logarithm."""
    return np.log((toxic + 0.5) / (toxics + 1)) - np.log((clean + 0.5) / (cleans + 1))


def _learn_ratios(model: Examples, group: np.ndarray, weight: np.ndarray, max_terms: int) -> np.ndarray:
    """Set the model's ratios; gives every example's sum and largest one as they are without its group."""
    sizes = np.diff(model.pointers)
    toxic_of, clean_of = weight * model.labels, weight * (1 - model.labels)
    toxic, clean = np.zeros(len(model.vocabulary)), np.zeros(len(model.vocabulary))
    for rows, part in model.parts():
        for into, of in ((toxic, toxic_of), (clean, clean_of)):
            into += np.bincount(model.columns[part], np.repeat(of[rows], sizes[rows]), len(into))
    cleans, toxics = clean_of.sum(), toxic_of.sum()
    model.ratio = np.zeros(len(model.vocabulary))
    often = np.flatnonzero(clean + toxic >= MIN_EXAMPLES_OF_TERM - 1e-9)
    if not len(often) or not cleans or not toxics:
        return np.zeros((len(model.ids), 2))
    found = _ratio(clean[often], toxic[often], cleans, toxics)
    kept = found >= 2 * math.log(max(1000, len(often))) - 2
    kept = often[kept][np.argsort(-found[kept], kind="stable")][:max_terms]
    model.ratio[kept] = _log_ratio(clean[kept], toxic[kept], cleans, toxics)
    entries = np.flatnonzero(np.isin(model.columns, kept))
    column, row = model.columns[entries], np.searchsorted(model.pointers, entries, "right") - 1
    own_toxic, own_clean = (np.bincount(group, x, len(group))[group] for x in (toxic_of, clean_of))
    without = _log_ratio(np.maximum(clean[column] - own_clean[row], 0), np.maximum(toxic[column] - own_toxic[row], 0),
                         np.maximum(cleans - own_clean[row], 0), np.maximum(toxics - own_toxic[row], 0))
    strongest = np.zeros(len(model.ids))
    np.maximum.at(strongest, row, without)
    return np.stack([np.bincount(row, without, len(model.ids)), strongest], 1)


def _joined(group: np.ndarray, rows: np.ndarray) -> None:
    """Make one group of those that the rows are in."""
    found = np.unique(group[rows])
    if len(found) > 1:
        group[np.isin(group, found)] = found[0]


def _own_neighbours(spark, model: Examples) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Every example's nearest others, and its group: what cosines of ALIKE or more link."""
    shared = spark.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = shared.value
        query, group = np.zeros(len(examples.vocabulary)), np.arange(len(examples.ids))
        names = ["row", "near", "cosines"]
        for batch in batches:
            rows, near = batch.column(0).to_pylist(), []
            for start in range(0, len(rows), BATCH):
                part = rows[start:start + BATCH]
                spans = [slice(examples.pointers[i], examples.pointers[i + 1]) for i in part]
                near += examples.nearest_of([(examples.columns[x], examples.values[x].astype(float)) for x in spans], NEIGHBOURS, part)
            for i in rows:
                span = slice(examples.pointers[i], examples.pointers[i + 1])
                at = examples.columns[span]
                query[at] = examples.values[span]
                _joined(group, np.append(np.flatnonzero(examples.cosines(query, 0, len(examples.ids)) >= ALIKE), i))
                query[at] = 0
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array([x[0].astype(np.int64).tobytes() for x in near], pa.binary()),
                                   pa.array([x[1].tobytes() for x in near], pa.binary())], names=names)
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([group.tobytes()], pa.binary()),
                               pa.array([b""], pa.binary())], names=names)

    tasks = -(-len(model.ids) // ROWS_PER_TASK)
    got = spark.range(0, len(model.ids), 1, tasks).mapInArrow(found, "row long, near binary, cosines binary").collect()
    shared.destroy()
    group = np.arange(len(model.ids))
    for r in got:
        if r["row"] < 0:
            other = np.frombuffer(bytes(r["near"]), np.int64)
            for row in np.flatnonzero(other != np.arange(len(other))):
                _joined(group, np.array([other[row], row]))
    return [(np.frombuffer(bytes(r["near"]), np.int64), np.frombuffer(bytes(r["cosines"])))
            for r in sorted(got, key=lambda r: r["row"]) if r["row"] >= 0], group


def _documents_with(vocabulary):
    """How many of a task's texts hold each word of the vocabulary, in slices; slice -1 counts texts with any word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts_ = vocabulary.value, 0
        seen = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held = set(words(text)) if text else ()
                if held:
                    texts_ += 1
                    keys = np.fromiter(map(_HASHES.__getitem__, held), np.uint64, len(held))
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    seen[at[known[at] == keys]] += 1
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([np.array([texts_]).tobytes()], pa.binary())], names=["slice", "counts"])
        for number, start in enumerate(range(0, len(known), SLICE)):
            if seen[start:start + SLICE].any():
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([seen[start:start + SLICE].tobytes()], pa.binary())],
                                      names=["slice", "counts"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[number] = sums.get(number, 0) + np.frombuffer(counts, np.int64)
    for number, counts in sums.items():
        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["slice", "counts"])


def document_frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all documents hold each word of the vocabulary, and how many have any word."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of at most max_entries words
    found = docs.select(quoted(text)).mapInArrow(_documents_with(shared), "slice int, counts binary").repartition(
        "slice").mapInArrow(_added, "slice int, counts binary").collect()  # 8 bytes a word
    counts, total = np.zeros(len(vocabulary), np.int64), 0
    for r in found:
        if r["slice"] < 0:
            total = int(np.frombuffer(r["counts"], np.int64)[0])
        else:
            part = np.frombuffer(r["counts"], np.int64)
            counts[r["slice"] * SLICE:r["slice"] * SLICE + len(part)] = part
    shared.unpersist()
    return counts, total


def _similar_first(model: Examples, sizes: np.ndarray) -> np.ndarray:
    """The rows in an order that has similar ones together: by the pivot that each is most alike."""
    pivots = np.linspace(0, len(sizes) - 1, min(PIVOTS, len(sizes))).astype(int)
    query, alike = np.zeros(len(model.vocabulary)), np.empty((len(pivots), len(sizes)))
    for number, pivot in enumerate(pivots):
        span = slice(model.pointers[pivot], model.pointers[pivot + 1])
        query[model.columns[span]] = model.values[span]
        alike[number] = model.cosines(query, 0, len(sizes))
        query[model.columns[span]] = 0
    chain, left = [0], set(range(1, len(pivots)))  # each pivot is followed by the one most alike of those left
    while left:
        chain.append(max(sorted(left), key=lambda i: alike[chain[-1], pivots[i]]))
        left.discard(chain[-1])
    of = np.argmax(alike[chain], axis=0)
    return np.lexsort((-alike[np.array(chain)[of], np.arange(len(sizes))], of))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *,
          usable: Column | None = None, max_examples: int = MAX_EXAMPLES, max_entries: int = MAX_ENTRIES,
          max_terms: int = MAX_TERMS, seed: int = 7) -> Examples:
    """The examples' index. `usable` is a condition on the labels' rows, all by default.

    Of the first `max_examples` labelled rows, in the order of a seeded hash, those are examples whose words still fit into
    `max_entries`; only these rows' ids, labels and words' hashes and counts (12 bytes a word) reach the driver, however
    long the texts and however often an id is repeated.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    known = (labels.filter(quoted(doc_id).isNotNull() & quoted(label).isNotNull()
                           & (F.lit(True) if usable is None else usable))
             .groupBy(quoted(doc_id).alias("example")).agg(F.max((quoted(label) > 0).cast("int")).alias("toxic")))
    turn = F.xxhash64(F.lit(seed), "example")
    chosen = known.orderBy(turn, "example").limit(max_examples)
    named = docs.select(quoted(doc_id).alias("doc"), quoted(text).alias("text"))
    place = scratch_path(spark, "examples")
    counted = written(spark, named.join(F.broadcast(chosen), F.col("doc") == F.col("example")).select(
        F.col("example").cast("string").alias("id"), "toxic", "text").mapInArrow(
            _counted, "id string, toxic int, hashes binary, counts binary").withColumn("mark", F.md5("hashes")).repartition(
                spark.sparkContext.defaultParallelism), place)  # a few rows of every file of documents
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id"), F.col("mark"), F.md5("counts")]
    taken, last = 0, 0
    for r in counted.select(F.octet_length("counts").alias("size"), *order).orderBy(*order).limit(max_examples).collect():
        if taken + r["size"] // 4 > max_entries:
            break
        taken, last = taken + r["size"] // 4, last + 1
    found = counted.orderBy(*order).limit(last).collect() if last else []
    discard(spark, place)
    base = sum(r["toxic"] for r in found) / len(found) if found else 0.0
    empty = [r["toxic"] for r in found if not r["hashes"]]
    found = [r for r in found if r["hashes"]]
    model = Examples(np.zeros(0, np.uint64), np.zeros(0), 0.0, [], np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32),
                     np.zeros(0, np.float32), base, base)
    if not 0 < base < 1 or not found:
        return model
    model.none_rate = (sum(empty) + base) / (len(empty) + 1)
    model.ids, model.labels = [r["id"] for r in found], np.array([r["toxic"] for r in found], float)
    sizes = np.array([len(r["counts"]) // 4 for r in found])
    model.pointers = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in found])
    model.values = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in found]).astype(np.float32)
    del found
    model.vocabulary = np.unique(hashes)
    model.columns = np.searchsorted(model.vocabulary, hashes).astype(np.int32)
    del hashes
    often, documents = document_frequencies(docs, text, model.vocabulary)
    model.idf, model.rarest = np.log(1 + documents / np.maximum(often, 1)), math.log(1 + documents)
    for rows, part in model.parts():
        weights = (1 + np.log(model.values[part].astype(float))) * model.idf[model.columns[part]]
        lengths = np.sqrt(np.add.reduceat(weights ** 2, model.pointers[rows] - part.start))
        model.values[part] = weights / np.repeat(lengths, sizes[rows])
    order = _similar_first(model, sizes)
    entries = np.concatenate([np.arange(model.pointers[i], model.pointers[i + 1]) for i in order])
    model.ids, model.labels, sizes = [model.ids[i] for i in order], model.labels[order], sizes[order]
    model.columns, model.values = model.columns[entries], model.values[entries]
    model.pointers = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    near, group = _own_neighbours(spark, model)
    weight = 1 / np.bincount(group, minlength=len(group))[group]
    ratios = _learn_ratios(model, group, weight, max_terms)
    signs = np.array([model.signs(*near[i], *ratios[i], sizes[i]) for i in range(len(sizes))])
    model.curve = _fitted_curve(signs, model.labels, weight)
    return model


def scorer(docs: DataFrame, model: Examples):
    """A column function: text to struct<score, shown, evidence: array of (example, similarity, toxic)>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most max_examples rows

    @F.pandas_udf("struct<score double, shown boolean, evidence array<struct<example string, similarity double, toxic int>>>")
    def scored(column: pd.Series) -> pd.DataFrame:
        examples, scores, shown, evidence = shared.value, [], [], []
        for score, rows, near, speaks in examples.scores(column.tolist()):
            scores.append(score)
            shown.append(bool(speaks))
            evidence.append([{"example": examples.ids[i], "similarity": float(s), "toxic": int(examples.labels[i])}
                             for i, s in zip(rows[:5], near[:5])])
        return pd.DataFrame({"score": scores, "shown": shown, "evidence": evidence})

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *,
             usable: Column | None = None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, score, predicted and evidence (the five nearest examples) of every row.

    A score is the calibrated vote of the nearest examples. A text without any word, also null and empty
    ones, gets the toxic share among the examples without any. Where labels of both kinds are
    missing nothing can be learned, and all texts get the labels' share of toxic ones, 0 without labels.
    Labels repeated for an id count as toxic if one of them is; null labels and ids are left out. Rows
    are scored one by one, so repeated or null ids come back as they are. Empty tables give empty ones;
    other columns are no input.
    """
    score = scorer(docs, learn(docs, labels, doc_id, text, label, usable=usable, max_examples=max_examples))
    found = docs.select(quoted(doc_id).alias("doc_id"), score(quoted(text)).alias("found"))
    return found.select("doc_id", F.col("found.score").alias("score"),
                        (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
                        F.col("found.evidence").alias("evidence"))
