"""Languages by error-correcting output codes over character n-grams.

Every language gets a codeword of bits. A bit's classifier tells the languages with 1 there from those
with 0: it is linear in the text's hashed byte n-grams, its weights the log ratio of the two sides'
n-gram frequencies. Training is a count of n-grams per language over all labelled texts, so it needs no
sample, and there is no limit to the languages: their counts stay on the cluster, where they are added up per bit
of the code (4 bits for each doubling of the languages), and a task holds HELD languages at a time. Decoding adds up, for every language, a logistic loss of each bit's margin, weighted by how
well that bit separates the language in training, and takes the codeword of least loss; a small lead
over the next one is flagged as ambiguous.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted, texts
from tidewater.session import scratch_path, written

GRAM = 3
FEATURES = 1 << 14
CHUNK = 1 << 16
SALTS = 16
HELD = 128
STEEPNESS = 4.0
AMBIGUOUS = 0.1
UNKNOWN = "und"


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed byte n-grams of the text between two spaces, with A-Z lower-cased, in chunks."""
    values = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    for start in range(0, len(values) - GRAM + 1, CHUNK):
        part = values[start:start + CHUNK + GRAM - 1].astype(np.uint32)
        code = np.zeros(len(part) - GRAM + 1, np.uint32)
        for i in range(GRAM):
            code = (code << np.uint32(8)) | part[i:len(part) - GRAM + 1 + i]
        yield ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's n-gram counts by language, a row per language and HELD languages met."""
    counts: dict[str, np.ndarray] = {}

    def held() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array([x.tobytes() for x in counts.values()], pa.binary())],
                               names=["lang", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            if lang not in counts and len(counts) >= HELD:
                yield held()
                counts.clear()
            total = counts.setdefault(lang, np.zeros(FEATURES, np.int64))
            for part in grams(text):
                total += np.bincount(part, minlength=FEATURES)
    yield held()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each language; they follow one another."""
    now, total = None, None
    for batch in batches:
        for lang, packed in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(packed, np.int64)
            if lang != now:
                if total is not None:
                    yield pa.record_batch([[now], [total.tobytes()]], names=["lang", "counts"])
                now, total = lang, part
            else:
                total = total + part
    if total is not None:
        yield pa.record_batch([[now], [total.tobytes()]], names=["lang", "counts"])


def _shares(packed: bytes) -> np.ndarray:
    counts = np.frombuffer(packed, np.int64) + 0.5
    return counts / counts.sum()


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 per language; of many random codes the one whose closest rows differ most."""
    if languages == 1:
        return np.ones((1, 1))
    bits = max(15, 4 * math.ceil(math.log2(languages)))
    random, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(200 if languages <= 64 else 5 if languages <= 2048 else 1):
        code = random.choice([-1.0, 1.0], (languages, bits))
        constant = np.abs(code.sum(axis=0)) == languages
        code[random.integers(languages, size=bits)[constant], np.flatnonzero(constant)] *= -1
        if languages > 2048:  # random rows of so many bits are far apart
            return code
        least = ((bits - code @ code.T) / 2 + bits * np.eye(languages)).min()
        if least > distance:
            best, distance = code, least
    return best


@dataclass
class LanguageModel:
    """Codewords, the bits' n-gram weights, and how far each bit can be trusted for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """The language, its probability and whether the next one is close."""
        if not self.languages:
            return UNKNOWN, 0.0, True
        if not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        total, count = np.zeros(self.weights.shape[1]), 0
        for part in grams(text):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            count += len(part)
        loss = (self.trust * np.logaddexp(0, -STEEPNESS * self.code * (total / count))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        chance = np.exp(-STEEPNESS * (loss - loss.min()))
        return (self.languages[order[0]], float(chance[order[0]] / chance.sum()),
                bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS))


def train(docs: DataFrame, lang: Column, text: Column, learn: Column) -> LanguageModel:
    """Count the n-grams of every row that `learn` holds for and that has a language.

    The driver gets the languages' names, the sums of two sides of each bit, and how far each language fits its bits.
    """
    spark = docs.sparkSession
    rows = docs.filter(learn & lang.isNotNull()).select(lang.alias("lang"), text.alias("text"))
    schema = "lang string, counts binary"
    partial = rows.mapInArrow(_count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    added = partial.repartition("lang", "salt").sortWithinPartitions("lang").select("lang", "counts").mapInArrow(_add, schema)
    summed = written(spark, added.repartition("lang").sortWithinPartitions("lang").mapInArrow(_add, schema),
                     scratch_path(spark, "languages"))
    languages = sorted(r["lang"] for r in summed.select("lang").collect())
    if not languages:
        return LanguageModel([], np.empty((0, 0)), np.empty((0, 0)), np.empty((0, 0)))
    code = codewords(len(languages))
    if len(languages) == 1:
        return LanguageModel(languages, code, np.zeros((FEATURES, 1)), np.ones((1, 1)))
    bits, shared = code.shape[1], spark.sparkContext.broadcast((languages, code))  # 4 bits x log2 of the languages each

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words = shared.value
        sums = np.zeros((2, bits, FEATURES))
        for batch in batches:
            for name, packed in zip(*(c.to_pylist() for c in batch.columns)):
                word, share = words[bisect_left(names, name)], _shares(packed)
                sums[0, word > 0] += share
                sums[1, word < 0] += share
        number = TaskContext.get().partitionId()
        for bit in range(bits):
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([bit], pa.int32()), pa.array([sums[:, bit].tobytes()])],
                                  names=["task", "bit", "sums"])

    def one_bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:  # in the order of tasks, so that a rerun adds alike
            for bit, packed in zip(*(c.to_pylist() for c in batch.columns)):
                total[bit] = total.get(bit, 0) + np.frombuffer(packed)
        for bit, sums in total.items():
            yield pa.record_batch([pa.array([bit], pa.int32()), pa.array([sums.tobytes()])], names=["bit", "sums"])

    ordered = summed.repartition("lang").sortWithinPartitions("lang")
    found = ordered.mapInArrow(sides, "task int, bit int, sums binary").repartition("bit").sortWithinPartitions("bit", "task").select(
        "bit", "sums").mapInArrow(one_bit, "bit int, sums binary").collect()
    sums = np.stack([np.frombuffer(r["sums"]).reshape(2, FEATURES) for r in sorted(found, key=lambda r: r["bit"])])
    ones, zeros = ((sign * code > 0).sum(axis=0)[:, None] for sign in (1, -1))
    weights = np.log(sums[:, 0] / ones) - np.log(sums[:, 1] / zeros)
    sent = spark.sparkContext.broadcast(weights)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([(sent.value @ _shares(x)).tobytes() for x in batch.column(1).to_pylist()],
                                                             pa.binary())], names=["lang", "fit"])

    fit = {r["lang"]: np.frombuffer(r["fit"]) for r in summed.mapInArrow(fits, "lang string, fit binary").collect()}
    margins = code * np.stack([fit[x] for x in languages])  # how clearly each language's own texts get its bits right
    weights = weights / np.maximum(np.abs(margins).mean(axis=0), 1e-9)[:, None]
    trust = np.maximum(margins / np.maximum(np.abs(margins).mean(axis=0), 1e-9), 1e-3)
    return LanguageModel(languages, code, np.ascontiguousarray(weights.T, np.float32),
                         trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *,
             learn: Column | None = None) -> DataFrame:
    """The language of every text: doc_id, lang_pred, score, ambiguous.

    Learns from the rows for which `learn` holds (all by default) and whose language is not null; the
    language is no input of a prediction. Null texts and texts without a letter are `und` with score 0
    and ambiguous, and so is everything where nothing can be learned. Rows are judged one by one, so
    repeated or null ids come back as they are; ties go to the language that sorts first; an empty table
    gives an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    model = spark.sparkContext.broadcast(train(
        docs, quoted(lang).cast("string"), quoted(text), F.lit(True) if learn is None else learn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(value) for value in texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()),
                                   pa.array([x[1] for x in found], pa.float64()),
                                   pa.array([x[2] for x in found], pa.bool_())],
                                  names=["doc", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(quoted(doc_id), quoted(text)).mapInArrow(
        run, f"doc {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("doc", "doc_id")
