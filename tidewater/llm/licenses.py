"""License notices in whole texts: exact phrases, and short notices with a few edits.

A notice of n characters may differ by e = n // EDIT_CHARS edits (one at least). Cut into e + 1 pieces,
one of them must stand in the text unchanged, so an automaton of all pieces finds every place where the
notice can be. There the regex library matches the notice with at most e edits and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted, texts

# Phrases whose every occurrence counts, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Openings of common notices, as words, with the labels they get.
NOTICES = {
    "general public license": "gpl",
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "licensed under the apache license": "apache",
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
}
EDIT_CHARS = 11

#: A-Z to lower case; what is no word character, to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Runs of digits, a-z and characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // EDIT_CHARS)


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than it may have edits: (offset, piece)."""
    count = edits_allowed(notice) + 1
    cuts = [len(notice) * i // count for i in range(count + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _machine():
    automaton, owners = ahocorasick.Automaton(), {}
    for notice in NOTICES:
        for offset, piece in pieces(notice):
            owners.setdefault(piece, []).append((notice, offset))
    for piece, held in owners.items():
        automaton.add_word(piece, (len(piece), held))
    automaton.make_automaton()
    patterns = {notice: regex.compile(f"(?:{regex.escape(notice)}){{e<={edits_allowed(notice)}}}", regex.BESTMATCH)
                for notice in NOTICES}
    return automaton, patterns


class Words:
    """A text's words between single spaces, and which word stands at a position."""

    def __init__(self, text: bytes):
        words = normal_words(text)
        self.count, self.padded = len(words), b" " + b" ".join(words) + b" "

    @cached_property
    def spaces(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.padded, np.uint8) == 32)

    def at(self, position: int) -> int:
        """The number of the word that the position, or the next one after a space, belongs to."""
        return int(np.searchsorted(self.spaces, position, "right")) - 1


def phrase_places(words: Words) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of every phrase."""
    found = []
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at = words.padded.find(wanted)
        while at >= 0:
            found.append((words.at(at), label))
            at = words.padded.find(wanted, at + 1)
    return found


def _matches(pattern, window: str, least: int) -> Iterator:
    """The best match of the window, then those of what is left on either side of it, `least` characters or more."""
    parts = [(0, len(window))]
    while parts:
        low, high = parts.pop()
        match = pattern.search(window, low, high) if high - low >= least else None
        if match and match.end() > match.start():
            yield match
            parts += [(low, match.start()), (match.end(), high)]


def fuzzy_places(words: Words) -> list[tuple[int, int, str, int, float]]:
    """(first word, end word, label, edits, similarity) of every notice found with few enough edits.

    Windows around neighbouring seeds are joined up to some lengths of the notice, so the search stays
    in proportion to the text also where seeds stand close together; what two windows both find is one
    place, the one with fewer edits.
    """
    automaton, patterns = _machine()
    windows: dict[str, list[list[int]]] = {}
    for end, (length, held) in automaton.iter(words.padded.decode("latin-1")):
        for notice, offset in held:
            reach, start = edits_allowed(notice), end + 1 - length - offset
            span = [max(0, start - 2 * reach - 1), start + len(notice) + 2 * reach + 1]
            known = windows.setdefault(notice, [])
            if known and span[0] <= known[-1][1] and span[1] - min(span[0], known[-1][0]) <= 6 * len(notice):
                known[-1][:] = min(known[-1][0], span[0]), max(known[-1][1], span[1])
            else:
                known.append(span)
    best: dict[tuple[int, int, str], tuple[int, float]] = {}
    for notice, spans in windows.items():
        for low, high in spans:
            while words.padded[low] & 0xC0 == 0x80:  # not in the middle of a character
                low -= 1
            while high < len(words.padded) and words.padded[high] & 0xC0 == 0x80:
                high += 1
            window = words.padded[low:high].decode("utf-8", "replace")
            for match in _matches(patterns[notice], window, len(notice) - edits_allowed(notice)):
                text = match.group().strip()
                if not text:
                    continue
                edits = sum(match.fuzzy_counts)
                first = words.at(low + len(window[:match.start()].encode()) + match.group().startswith(" "))
                place = (first, first + len(text.split()), NOTICES[notice])
                best[place] = min(best.get(place, (edits, 0.0)), (edits, 1 - edits / len(notice)), key=lambda x: -x[1])
    return [(*place, edits, share) for place, (edits, share) in sorted(best.items())]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts(batch.column(1)):
            words = Words(text)
            base, fuzzy = phrase_places(words), fuzzy_places(words)
            starts = [start for start, _ in base]
            rows.append({
                "n_words": words.count, "n_base": len(base),
                "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(sorted({label for _, label in base})),
                "labels": ",".join(sorted({label for _, label in base} | {label for _, _, label, _, _ in fuzzy})),
                "score": 1.0 if base else max((x[4] for x in fuzzy), default=0.0),
                "spans": [{"first": a, "end": b, "label": label, "edits": edits} for a, b, label, edits, _ in sorted(fuzzy)],
            })
        out = pa.Table.from_pylist(rows, schema=_OUT).to_batches() if rows else [pa.RecordBatch.from_pylist([], _OUT)]
        for part in out:
            yield pa.record_batch([batch.column(0), *part.columns], names=["doc", *_OUT.names])


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                  ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()),
                                                ("edits", pa.int64())])))])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """License phrases and notices of every text: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans.

    `n_base` counts the places of the exact phrases, `first_word` and `last_word` are the smallest and
    largest of their starts (null if none). `spans` are the fuzzy matches as first word, end word
    (exclusive), label and edits. `score` is 1 with an exact phrase, else the best match's share of
    unedited characters, 0 without any. A null or empty text has no words and no labels. Rows are judged
    one by one, so repeated or null ids come back as they are; other columns are not looked at.
    """
    prepare_python(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(quoted(doc_id), quoted(text)).mapInArrow(
        _scan, f"doc {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
               "labels string, score double, spans array<struct<first: long, end: long, label: string, edits: long>>")
    return found.select(F.col("doc").alias("doc_id"), *found.columns[1:])
