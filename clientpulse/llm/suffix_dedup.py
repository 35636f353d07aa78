"""Suffix-array dedup of bytes, with deep-shallow sorting.

The corpus is sampled into anchored segments (``anchors.py``) and dealt to shards by
anchor. A shard's suffixes start at the anchors. They are sorted in two steps:
multikey quicksort orders them on their first ``SHALLOW`` bytes; a group that still
agrees then has a long common prefix, and a blind trie orders it, looking at one byte
per branch and comparing whole strings once per insertion. The sorted order gives the
length of the common prefix of neighbours, and the least of those between two
suffixes is theirs. A window is repeated if another segment agrees with its segment
for enough bytes right of the anchor, by the sorted order, and left of it.

Defined cases: a null text counts as an empty one; texts shorter than a window lose
nothing. Equal texts of at least a window lose everything, as each occurs elsewhere.
Windows overlap, and are judged on the input. Ids may be null or repeated. A cut may
leave bytes that are no UTF-8, so ``drop_repeats`` replaces those by U+FFFD. Extra
columns, whatever their names, come along there. Empty tables give empty results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientpulse.llm.anchors import Repeats, Units
from clientpulse.llm.bitmap import meet_spans
from clientpulse.llm.common import quoted, slices, text_of

WIDTH = 400
GRAM = 128
SHALLOW = 12


# --- sorting ----------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    i, most, step = start, min(len(a), len(b)), 32
    while i < most and a[i : i + step] == b[i : i + step]:
        i += step
        step *= 2
    low, high = i, min(i + step, most)
    while low < high:
        middle = (low + high + 1) // 2
        if a[i:middle] == b[i:middle]:
            low = middle
        else:
            high = middle - 1
    return min(low, most)


def quicksort_shallow(suffixes: list[bytes], order: list[int]) -> Iterator[list[int]]:
    """Multikey quicksort of ``order`` on the first ``SHALLOW`` bytes; yields groups of
    suffixes that agree so far, in order. A suffix that has ended sorts first."""
    stack = [(order, 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2 or depth >= SHALLOW:
            yield part
            continue
        pivot = suffixes[part[len(part) // 2]][depth : depth + 1]
        less, equal, more = [], [], []
        for i in part:
            key = suffixes[i][depth : depth + 1]
            (equal if key == pivot else less if key < pivot else more).append(i)
        if more:
            stack.append((more, depth))
        stack.append((equal, depth + 1 if pivot else SHALLOW))
        if less:
            stack.append((less, depth))


class Node:
    """A branch of a blind trie: where its strings differ first, and its children by the
    byte there (-1 for strings that end). ``any`` is one string below it."""

    __slots__ = ("any", "children", "depth")

    def __init__(self, depth: int, some: int):
        self.depth, self.any, self.children = depth, some, {}


def blind_trie(suffixes: list[bytes], group: list[int]) -> list[int]:
    """``group`` sorted; its strings have a long common prefix."""

    def byte(i: int, depth: int) -> int:
        return suffixes[i][depth] if depth < len(suffixes[i]) else -1

    root: Node | list[int] = [group[0]]  # a leaf holds equal strings
    for new in group[1:]:
        # walk down blindly, then compare once with what was reached
        at, path = root, []
        while isinstance(at, Node):
            path.append(at)
            key = byte(new, at.depth)
            if key not in at.children:
                break
            at = at.children[key]
        other = at.any if isinstance(at, Node) else at[0]
        depth = common_prefix(suffixes[new], suffixes[other])
        if isinstance(at, list) and depth == len(suffixes[new]) == len(suffixes[other]):
            at.append(new)
            continue
        parent = None
        for node in path:
            if node.depth >= depth:
                break
            parent = node
        below = root if parent is None else parent.children.get(byte(new, parent.depth))
        if isinstance(below, Node) and below.depth == depth:
            below.children[byte(new, depth)] = [new]
            continue
        if below is None:
            parent.children[byte(new, parent.depth)] = [new]
            continue
        branch = Node(depth, other)
        branch.children[byte(other, depth)] = below
        branch.children[byte(new, depth)] = [new]
        if parent is None:
            root = branch
        else:
            parent.children[byte(new, parent.depth)] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            out += at
        else:
            stack += [at.children[k] for k in sorted(at.children, reverse=True)]
    return out


def deep_shallow(suffixes: list[bytes]) -> list[int]:
    """Indices of the suffixes in sorted order."""
    out: list[int] = []
    for group in quicksort_shallow(suffixes, list(range(len(suffixes)))):
        out += blind_trie(suffixes, group) if len(group) > 1 else group
    return out


# --- a shard's index -----------------------------------------------------------------


def repeated_windows(
    contents: list[bytes], places: list[int], counts: list[int], times: list[int], sizes: list[int]
) -> list[np.ndarray]:
    """Windows of each segment that another segment of its anchor group has, too."""
    right = [c[p:] for c, p in zip(contents, places)]
    left = [c[:p][::-1] for c, p in zip(contents, places)]
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = deep_shallow(right)
    # within the order, each group's suffixes
    order.sort(key=group.__getitem__)
    found = [np.zeros(n, dtype=bool) for n in counts]
    start = 0
    for size in sizes:
        own = order[start : start + size]
        shared = [common_prefix(right[a], right[b]) for a, b in zip(own, own[1:])]
        for i, s in enumerate(own):
            if times[s] > 1:
                found[s][:] = True
                continue
            for step in (1, -1):
                reach, j = len(right[s]), i
                while 0 <= j + step < size:
                    reach = min(reach, shared[j] if step > 0 else shared[j - 1])
                    j += step
                    # windows start at most places[s] before the anchor
                    if reach < WIDTH - places[s] or found[s].all():
                        break
                    back = common_prefix(left[s], left[own[j]])
                    low, high = max(0, places[s] - back), min(counts[s] - 1, places[s] + reach - WIDTH)
                    found[s][low : high + 1] = True
        start += size
    return found


# --- cutting texts ----------------------------------------------------------------------


def cut(raw: bytes, spans: list[list[int]]) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed, and of runs."""
    edges = np.zeros(len(raw) + 1, dtype=np.int64)
    for first, end in spans or []:
        edges[first] += 1
        edges[end + WIDTH - 1] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text, spans in zip(*(c.to_pylist() for c in batch.columns[1:])):
            raw = text.encode()
            left, removed, runs = cut(raw, spans)
            rows.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest()))
        n, removed, runs, sha = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def with_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    repeats = Repeats(docs, Units(False, WIDTH, GRAM), repeated_windows, False, id_col, text_col)
    met = meet_spans(docs, repeats.covered(), False, id_col, text_col)
    repeats.scratch.clear()  # the spans are stored
    return met


def repeat_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    clean, dirty, name = with_spans(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    zero = F.lit(0).cast("bigint")
    plain = clean.select(
        quoted(id_col).alias("doc_id"),
        F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2(text_of(text_col), 256).alias("kept_sha256"),
    )
    rows = dirty.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"), quoted(name).alias("spans"))
    return plain.unionByName(rows.mapInArrow(digest_batches, schema))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts."""
    clean, dirty, name = with_spans(docs, id_col, text_col)
    names = docs.columns
    place, width = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column(place).to_pylist(), batch.column(width).to_pylist())
            texts = [t if t is None else cut(t.encode(), s)[0].decode(errors="replace") for t, s in pairs]
            arrays = list(batch.columns[:width])
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return clean.unionByName(dirty.mapInArrow(run, T.StructType(docs.schema.fields)))
