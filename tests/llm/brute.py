"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def shingles(words, width):
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def line_dedup(rows):
    """rows: (doc_id, text); gives (doc_id, n_lines, n_dropped, kept text)."""
    def key(line):
        found = ascii_lower(line.strip(BLANKS))
        return found if len(found) >= 10 else None

    holders = defaultdict(set)
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                if key(line):
                    holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or not key(x) or min(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def near_duplicates(rows, width, percent):
    """rows: (doc_id, text); gives {doc_id: smallest id reachable}."""
    sets = {doc_id: shingles(split_words(text), width) for doc_id, text in rows if doc_id is not None}
    inverted = defaultdict(list)
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc_id, own in sets.items():
        shared = Counter(other for s in own for other in inverted[s])
        for other, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                a, b = find(doc_id), find(other)
                root[max(a, b)] = min(a, b)
        for s in own:
            inverted[s].append(doc_id)
    return {doc_id: find(doc_id) for doc_id in sets}


def contaminated(rows, items, width=5, threshold=0.8):
    """Pairs (doc_id, item_id, item shingles, shared)."""
    def parts(text):
        return shingles([w for w in re.split(r"[^\w]|_", (text or "").lower()) if w], width)

    wanted = [(item_id, parts(text)) for item_id, text in items if parts(text)]
    out = set()
    for doc_id, text in rows:
        held = parts(text)
        for item_id, need in wanted:
            if len(need & held) >= len(need) - math.floor(len(need) * (1 - threshold) + 1e-9):
                out.add((doc_id, item_id, len(need), len(need & held)))
    return out


def mix(rows, weights=(1, 2, 3), epochs=3, seed="mix"):
    """rows: (doc_id, text, source); gives (doc_id, size, source_size, target, taken), by repeated clamping."""
    sized = [(doc_id, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))) for doc_id, text, source in rows]
    sizes = Counter()
    for _, source, size in sized:
        sizes[source] += size
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            break
        clamped |= over
    target = {s: float(epochs * sizes[s]) if s in clamped else weight[s] * level for s in order}
    ahead, out = Counter(), []
    for doc_id, source, size in sorted(sized, key=lambda r: (
            hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])):
        goal = math.floor(target[source] + 0.5)
        whole, rest = divmod(goal, sizes[source]) if sizes[source] else (0, 0)
        out.append((doc_id, size, sizes[source], target[source],
                    whole * size + max(0, min(size, rest - ahead[source]))))
        ahead[source] += size
    return out
