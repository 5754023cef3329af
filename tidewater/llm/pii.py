"""Personal data: base patterns, and a character-level BiLSTM with CRF transitions that adds to them.

The network is trained in numpy on windows with labelled spans, a bounded sample of them (MAX_WINDOWS, chosen by
hash): what the base patterns mark, also in copies of the text that are written as these patterns do not expect
(`altered`: a domain beyond ASCII, other separators, another international prefix), and secrets, which have no base
pattern (`labelled_spans`). Texts are cut into overlapping windows; all windows with a
digit or @, without which no kind of span can exist, are decoded. Parts of a span that window edges cut are joined with
the neighbouring windows' parts. What the windows find is reconciled over the whole text: base spans stay, and of
the rest the set of spans without overlap that has the largest total confidence is added, if the model
is sure of them and they can be what they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted

#: In the order in which spans of equal start are listed. The last has no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
WINDOW, STRIDE = 96, 48
MAX_WINDOWS = 1500
EPOCHS = 24
BATCH = 64
EMBEDDING, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)  # outside; beginning and inside of each kind
SURE = 0.9
DECODE = 512

Span = tuple[int, int, int]  # kind, start, end (exclusive), in code points

# The base patterns' character classes. The look-behinds only keep a search from starting
# within a run that it has already tried from its first character.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each holds one @, so they are found from these, in one pass over the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, *span) for span in _emails(text)]
    if _ANCHOR.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255
                                                                   for p in m.group().split("."))]
        for match in _CARD.finditer(text):
            digits = _digits(match.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *match.span()))
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


_SECRET = re.compile(r"(?i)(?:token|secret|password|key)\"?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/-]{16,128})(?![A-Za-z0-9_+/-])")


def labelled_spans(text: str) -> list[Span]:
    """What the tagger learns from: the base spans, and long values that are named a secret."""
    secrets = [(4, *m.span(1)) for m in _SECRET.finditer(text) if plausible(4, m.group(1))]
    return sorted([*base_spans(text), *secrets], key=lambda s: (s[1], s[0], s[2]))


def altered(text: str, spans: list[Span]) -> str:
    """The text, of equal length, with its spans written in ways that the base patterns do not know."""
    out = list(text)
    for kind, start, end in spans:
        if kind == 0:  # a letter of the domain beyond ASCII
            at = next((i for i in range(text.index("@", start) + 1, end) if out[i].isalpha()), None)
            if at is not None:
                out[at] = "éüöñ"[(end - start) % 4]
        elif kind == 2:
            out[start:end] = ["." if c in " -" else c for c in out[start:end]]
        elif kind == 3:
            out[start] = "0"
    return "".join(out)


def plausible(kind: int, text: str) -> bool:
    """Whether an added span can be of its kind."""
    digits = _digits(text)
    if kind == 4:
        return len(text) >= 16 and len(digits) >= 2 and any(map(str.isalpha, text)) and not any(map(str.isspace, text))
    if kind == 0:
        return "@" in text and "." in text.rpartition("@")[2]
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in text.split("."))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def spelled(kind: int, text: str) -> bool:
    """Whether an offer starts as the spellings that the tagger learns do: phones with a prefix or a parenthesis."""
    return kind != 3 or text[:1] in "+0("


_PUNCTUATION = " \n.,:;@+-_%()/\\'\"=<>[]#&!?*|"
_CODES = np.full(128, 3, np.uint8)
for _place, _char in enumerate(_PUNCTUATION):
    _CODES[ord(_char)] = 4 + _place
for _digit in "0123456789":
    _CODES[ord(_digit)] = 4 + len(_PUNCTUATION)
for _place, _letter in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODES[ord(_letter)] = _CODES[ord(_letter.upper())] = 5 + len(_PUNCTUATION) + _place
SYMBOLS = 5 + len(_PUNCTUATION) + 26  # 0 pads, 2 is anything beyond ASCII


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 2).astype(np.uint8)


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows, STRIDE apart, that hold a digit or @."""
    anchors = np.flatnonzero((codes == _CODES[ord("@")]) | (codes == _CODES[ord("0")]))
    if not len(anchors):
        return anchors
    last = anchors // STRIDE
    return np.unique(np.concatenate([last, np.maximum(last - 1, 0)])) * STRIDE


def window_codes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.zeros(WINDOW, np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def _tags(spans: list[Span], start: int) -> np.ndarray:
    """The tags of a window; a span cut by its left edge goes on inside."""
    tags = np.zeros(WINDOW, np.uint8)
    for kind, a, b in spans:
        low, high = max(a - start, 0), min(b - start, WINDOW)
        if low < high:
            tags[low:high] = 2 + 2 * kind
            if a >= start:
                tags[low] = 1 + 2 * kind
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Embedding, an LSTM in either direction, a linear layer of tag scores, and CRF transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        random = np.random.default_rng(seed)

        def matrix(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {"embedding": matrix(SYMBOLS, EMBEDDING), "output": matrix(2 * HIDDEN, TAGS),
                   "output_bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
        for side in ("forward", "backward"):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            weights |= {f"{side}_input": matrix(EMBEDDING, 4 * HIDDEN), f"{side}_state": matrix(HIDDEN, 4 * HIDDEN),
                        f"{side}_bias": bias}
        return cls(weights)

    def _lstm(self, side: str, inputs: np.ndarray) -> tuple[np.ndarray, list]:
        """States of every step of inputs (step, window, embedding), and what the backward pass needs."""
        w, u, b = (self.weights[f"{side}_{part}"] for part in ("input", "state", "bias"))
        fed = inputs @ w + b
        state = memory = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        states, trace = np.empty((*inputs.shape[:2], HIDDEN), np.float32), []
        for step in range(len(inputs)):
            gates = fed[step] + state @ u
            opened = _sigmoid(gates[:, :3 * HIDDEN])
            new = np.tanh(gates[:, 3 * HIDDEN:])
            take, keep, show = (opened[:, i * HIDDEN:(i + 1) * HIDDEN] for i in range(3))
            before, held = memory, state
            memory = keep * memory + take * new
            shown = np.tanh(memory)
            states[step] = state = show * shown
            trace.append((take, keep, show, new, before, shown, held))
        return states, trace

    def scores(self, codes: np.ndarray, trace: bool = False):
        """Tag scores (step, window, tag) of windows (window, step)."""
        inputs = self.weights["embedding"][codes.T]
        forward, forward_trace = self._lstm("forward", inputs)
        backward, backward_trace = self._lstm("backward", inputs[::-1])
        states = np.concatenate([forward, backward[::-1]], axis=2)
        scores = states @ self.weights["output"] + self.weights["output_bias"]
        return (scores, states, inputs, forward_trace, backward_trace) if trace else scores

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each step's tag probabilities, and the expected number of each move per batch."""
        moves = np.exp(self.weights["moves"])
        chance = np.exp(scores - scores.max(axis=2, keepdims=True))
        steps = len(scores)
        ahead, behind, scale = np.empty_like(chance), np.ones_like(chance), np.empty((*chance.shape[:2], 1))
        for step in range(steps):
            value = chance[step] * (ahead[step - 1] @ moves) if step else chance[0]
            scale[step] = value.sum(axis=1, keepdims=True)
            ahead[step] = value / scale[step]
        for step in range(steps - 2, -1, -1):
            behind[step] = ((chance[step + 1] * behind[step + 1]) @ moves.T) / scale[step + 1]
        after = chance[1:] * behind[1:] / scale[1:]
        pairs = moves * (ahead[:-1].reshape(-1, TAGS).T @ after.reshape(-1, TAGS))
        return ahead * behind, pairs

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the tags (window, step)."""
        scores, states, inputs, *traces = self.scores(codes, trace=True)
        expected, pairs = self.marginals(scores)
        gold = np.eye(TAGS, dtype=np.float32)[tags.T]
        count = len(codes)
        d_scores = ((expected - gold) / count).astype(np.float32)
        found = {"moves": (pairs - gold[:-1].reshape(-1, TAGS).T @ gold[1:].reshape(-1, TAGS)) / count,
                 "output": states.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS),
                 "output_bias": d_scores.sum(axis=(0, 1))}
        d_states = d_scores @ self.weights["output"].T
        d_inputs = np.zeros_like(inputs)
        for side, trace, turn, part in (("forward", traces[0], 1, slice(0, HIDDEN)),
                                        ("backward", traces[1], -1, slice(HIDDEN, None))):
            w, u = self.weights[f"{side}_input"], self.weights[f"{side}_state"]
            outer, d_gates = d_states[::turn, :, part], np.empty((*inputs.shape[:2], 4 * HIDDEN), np.float32)
            d_state = d_memory = np.zeros((inputs.shape[1], HIDDEN), np.float32)
            d_u = np.zeros_like(u)
            for step in range(len(trace) - 1, -1, -1):
                take, keep, show, new, before, shown, held = trace[step]
                d_out = outer[step] + d_state
                d_memory = d_memory + d_out * show * (1 - shown * shown)
                gates = np.concatenate([d_memory * new * take * (1 - take), d_memory * before * keep * (1 - keep),
                                        d_out * shown * show * (1 - show), d_memory * take * (1 - new * new)], axis=1)
                d_gates[step] = gates
                d_u += held.T @ gates
                d_state, d_memory = gates @ u.T, d_memory * keep
            flat = d_gates.reshape(-1, 4 * HIDDEN)
            found |= {f"{side}_state": d_u, f"{side}_bias": flat.sum(axis=0),
                      f"{side}_input": inputs[::turn].reshape(-1, EMBEDDING).T @ flat}
            d_inputs[::turn] += d_gates @ w.T
        embedding = np.zeros_like(self.weights["embedding"])
        np.add.at(embedding, codes.T, d_inputs)
        return found | {"embedding": embedding}

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 3) -> Tagger:
        """Adam over shuffled batches, the same order for the same seed."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = random.permutation(len(codes))
            for start in range(0, len(codes), BATCH):
                rows = order[start:start + BATCH]
                step += 1
                pace = rate * 0.5 ** (4 * epoch / epochs)
                for name, slope in self.gradients(codes[rows], tags[rows]).items():
                    slope = np.clip(slope, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.99 * second[name] + 0.01 * slope * slope
                    change = (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - pace * change).astype(np.float32)
        return self

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of windows (window, step), and the probability of each."""
        scores = self.scores(codes)
        steps, count, _ = scores.shape
        best, came = scores[0], np.empty((steps, count, TAGS), np.int8)
        for step in range(1, steps):
            total = best[:, :, None] + self.weights["moves"]
            came[step] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[step]
        tags = np.empty((steps, count), np.int64)
        tags[-1] = best.argmax(axis=1)
        for step in range(steps - 1, 0, -1):
            tags[step - 1] = came[step][np.arange(count), tags[step]]
        sure = np.zeros((count, steps))
        marked = np.flatnonzero((tags > 0).any(axis=0))
        if len(marked):
            chance, _ = self.marginals(scores[:, marked])
            sure[marked] = np.take_along_axis(chance, tags[:, marked, None], axis=2)[:, :, 0].T
        return tags.T, sure


Part = tuple[float, Span, bool, bool]  # confidence, span, whether the window's edge cuts it on the left, on the right


def _tagged_parts(tags: np.ndarray, sure: np.ndarray, start: int, length: int) -> Iterator[Part]:
    """A window's spans, also those that its edges cut."""
    at = 0
    while at < WINDOW:
        tag = int(tags[at])
        if tag == 0:
            at += 1
            continue
        kind, end = (tag - 1) // 2, at + 1
        while end < WINDOW and tags[end] == 2 + 2 * kind:
            end += 1
        if start + end <= length and (tag % 2 == 1 or at == 0):
            yield (float(sure[at:end].mean()), (kind, start + at, start + end), at == 0 and start > 0,
                   end == WINDOW and start + end < length)
        at = end


def joined_parts(parts: list[Part]) -> list[tuple[float, Span]]:
    """Whole spans: those that no edge cuts, and parts that are continued in the next window."""
    out, held = [], {}  # of each kind the part that goes on
    for chance, (kind, start, end), left, right in sorted(parts, key=lambda p: (p[1][1], p[1][2])):
        known = held.get(kind)
        if known and start <= known[1][2] and (left or start >= known[1][1]) and end >= known[1][2]:
            chance, start, left = min(chance, known[0]), known[1][1], known[2]
        elif left:
            continue
        if right:
            held[kind] = chance, (kind, start, end), left
        elif not left:
            out.append((chance, (kind, start, end)))
    return out


def reconciled(base: list[Span], offered: list[tuple[float, Span]], text: str) -> list[Span]:
    """Base spans and the sure, plausible offers beside them: of overlapping ones the set of largest total."""
    starts = [start for _, start, _ in base]
    reach = list(accumulate((end for _, _, end in base), max))
    best: dict[Span, float] = {}
    for chance, span in offered:
        before = bisect_left(starts, span[2])  # base spans that start ahead of its end
        if chance >= SURE and not (before and reach[before - 1] > span[1]) and plausible(
                span[0], text[span[1]:span[2]]):
            best[span] = max(best.get(span, 0.0), chance)
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [end for _, _, end in spans]
    totals, chosen = [0.0], []  # of the first spans; whether the last of them is in, and what it follows
    for place, span in enumerate(spans):
        free = bisect_right(ends, span[1], 0, place)
        with_it = totals[free] + best[span]
        chosen.append((with_it > totals[place], free))
        totals.append(max(totals[place], with_it))
    added, place = [], len(spans)
    while place:
        taken, free = chosen[place - 1]
        if taken:
            added.append(spans[place - 1])
        place = free if taken else place - 1
    return sorted([*base, *added], key=lambda s: (s[1], s[0], s[2]))


def all_spans(values: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text. The windows of all texts are decoded together."""
    base = [base_spans(value) for value in values]
    offered: list[list[Part]] = [[] for _ in values]
    if tagger is not None:
        held, owners = [], []

        def flush() -> None:
            for low in range(0, len(owners), DECODE):
                tags, sure = tagger.decode(np.concatenate(held)[low:low + DECODE])
                for (owner, start), row, chance in zip(owners[low:low + DECODE], tags, sure):
                    if row.any():
                        offered[owner] += _tagged_parts(row, chance, start, len(values[owner]))
            held.clear()
            owners.clear()

        for owner, value in enumerate(values):
            if _ANCHOR.search(value):
                codes = encode(value)
                starts = window_starts(codes)
                held.append(window_codes(codes, starts))
                owners += [(owner, int(start)) for start in starts]
                if len(owners) >= 4 * DECODE:
                    flush()
        if owners:
            flush()
    whole = [[(chance, span) for chance, span in joined_parts(offer) if spelled(span[0], value[span[1]:span[2]])]
             for offer, value in zip(offered, values)]
    return [(known, reconciled(known, offer, value) if offer else known)
            for known, offer, value in zip(base, whole, values)]


def train(docs: DataFrame, text: Column, *, max_windows: int = MAX_WINDOWS,
          label: Callable[[str], list[Span]] = base_spans,
          alter: Callable[[str, list[Span]], str] | None = None) -> Tagger | None:
    """Fit a tagger to at most `max_windows` windows of the texts, those of smallest hash.

    `label` gives a text's labelled spans, `alter` the text in another spelling with the same spans. Only codes and
    tags of these windows reach the driver.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, tags = [], []
            for value in batch.column(0).to_pylist():
                spans = label(value)
                for written_ in {value, alter(value, spans) if alter else value}:
                    encoded = encode(written_)
                    starts = window_starts(encoded)
                    codes += [row.tobytes() for row in window_codes(encoded, starts)]
                    tags += [_tags(spans, int(start)).tobytes() for start in starts]
            yield pa.record_batch([pa.array(codes, pa.binary()), pa.array(tags, pa.binary())], names=["codes", "tags"])

    found = docs.filter(text.rlike("[0-9@]")).select(text.alias("text")).mapInArrow(
        windows, "codes binary, tags binary").distinct()
    chosen = found.orderBy(F.xxhash64("codes", "tags"), "codes", "tags").limit(max_windows).collect()
    if not chosen:
        return None
    codes, tags = (np.stack([np.frombuffer(bytes(r[name]), np.uint8) for r in chosen]) for name in ("codes", "tags"))
    return Tagger.fresh().fit(codes, tags)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                       max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id and the spans of every text: base (those of the patterns) and spans (the tagger's too), as
    arrays of kind, start, end in code points, by start and then kind. Secrets are found by the tagger only.

    A null or empty text has no spans. Where no text has a digit or @ there is nothing to train on and
    nothing to find. Rows are judged one by one, so repeated or null ids come back as they are; an empty
    table gives an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    tagger = spark.sparkContext.broadcast(train(
        docs, quoted(text), max_windows=max_windows, label=labelled_spans, alter=altered))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([value or "" for value in batch.column(1).to_pylist()], tagger.value)
            columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in row[side]] for row in found], spans)
                       for side in (0, 1)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc", "base", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    row = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(quoted(doc_id), quoted(text)).mapInArrow(
        run, f"doc {kind}, base {row}, spans {row}").withColumnRenamed("doc", "doc_id")
