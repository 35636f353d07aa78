"""The contracts of the operators on documents, in plain Python over small lists."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words_of(text) -> list[str]:
    return WORD.findall(text or "")


def covered_by(starts, width) -> set[int]:
    return {i for s in starts for i in range(s, s + width)}


def base_counts(text) -> dict:
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    n_repeat = len(covered_by([i for v in at.values() if len(v) > 1 for i in v], 8))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": n_repeat,
        "base_failed": len(words) < 20 or 100 * n_repeat > 30 * len(words),
    }


def removed_bytes(texts: list, width: int = 400) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept sha) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        cut = covered_by([i for i in range(len(r) - width + 1) if count[r[i : i + width]] > 1], width)
        spans = sum(i - 1 not in cut for i in cut)
        out.append((len(r), len(cut), spans, sha(bytes(b for i, b in enumerate(r) if i not in cut))))
    return out


def removed_words(rows: list[tuple], width: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept sha) of (doc_id, text) rows; smaller ids come first, null last."""
    out, seen = [], set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words_of(text)
        starts = []
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                starts.append(i)
            seen.add(key)
        cut = covered_by(starts, width)
        out.append((doc_id, len(w), len(cut), sha(" ".join(x for i, x in enumerate(w) if i not in cut))))
    return out


def shingles(text) -> frozenset:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(rows: list[tuple], percent: int = 75) -> dict:
    """doc_id: (n_shingles, component_id) over all pairs of (doc_id, text) rows."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for ds in holders.values():
        ds.sort()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def mix_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Target of each source from its words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    total = sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if w else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: float(most * sizes[s]) for s in over}
