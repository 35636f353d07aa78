"""Substring dedup of words, with an FM-index per shard.

The corpus is sampled into anchored segments (``anchors.py``) and dealt to shards by
anchor, each group in the order of the corpus. A shard's words become numbers; the
Burrows-Wheeler transform of their sequence is kept in a wavelet matrix of packed bits
with counts per 64. Backward search runs from each segment's windows, last word first,
all at once; a window whose range has shrunk to one row has no other occurrence, and
its matching statistic is below the threshold. What is left after ``WIDTH`` steps
occurs again, and all but the earliest of a range are repeats.

The suffixes are sorted to a depth above ``WIDTH``, which is all that searches of
``WIDTH`` words can tell.

Defined cases: null and empty texts, and texts without words, have no words; texts
shorter than a window lose nothing. Windows overlap and are judged on the input. Of
equal texts the one with the smallest id is left; null ids come last, in the order of
the texts' hashes. Rows that agree in id and text are one document and treated alike.
Extra columns, whatever their names, come along in ``drop_later``. Empty tables give
empty results."""

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

WIDTH = 20
GRAM = 7
UNITS = Units(True, WIDTH, GRAM)


class WaveletMatrix:
    """Rank queries over a sequence of numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n = levels, len(values)
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def follow(self, symbols: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Where ``index`` ends up in the last level along the bits of each symbol."""
        for depth, level in enumerate(range(self.levels - 1, -1, -1)):
            word, rest = index >> 6, (index & 63).astype(np.uint64)
            below = self.bits[depth][word] & ((np.uint64(1) << rest) - np.uint64(1))
            ones = self.counts[depth][word] + np.bitwise_count(below)
            index = np.where((symbols >> level) & 1, self.zeros[depth] + ones, index - ones)
        return index


class FMIndex:
    """Backward search over a sequence of numbers; 0 separates its parts."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while step <= WIDTH:
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
            step *= 2
        suffixes = np.argsort(rank, kind="stable")
        symbols = int(text.max()) + 1
        self.tree = WaveletMatrix(text[suffixes - 1], max(1, (symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        every = np.arange(symbols)
        self.origin = self.tree.follow(every, np.zeros(symbols, dtype=np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes with one more symbol in front."""
        base = self.before[symbols] - self.origin[symbols]
        return base + self.tree.follow(symbols, low), base + self.tree.follow(symbols, high)


def matched(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows at ``starts`` with a matching statistic of ``WIDTH`` elsewhere, and
    the first row of each one's range."""
    index = FMIndex(text)
    low = np.zeros(len(starts), dtype=np.int64)
    high = np.full(len(starts), len(text), dtype=np.int64)
    for back in range(WIDTH - 1, -1, -1):
        low, high = index.extend(text[starts + back], low, high)
        more = high - low > 1
        starts, low, high = starts[more], low[more], high[more]
    return starts, low


def later_windows(
    contents: list[bytes], places: list[int], counts: list[int], times: list[int], sizes: list[int]
) -> list[np.ndarray]:
    """Windows of each segment that an earlier segment has, too."""
    hashes = [UNITS.read(c)[2] for c in contents]
    lengths = np.array([len(h) for h in hashes])
    offsets = np.cumsum(lengths + 1) - lengths - 1
    # a word that the shard has once is in no repeat: it separates, and the alphabet is smaller
    _, numbers, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    numbers = np.where(often > 1, np.cumsum(often > 1), 0)[numbers]
    text = np.zeros(int(lengths.sum()) + len(lengths), dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[offsets + lengths] = False
    text[inside] = numbers
    counts = np.array(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[owner]
    separators = np.concatenate([[0], np.cumsum(text == 0)])
    starts = starts[separators[starts] == separators[starts + WIDTH]]
    again, rows = matched(text, starts)
    order = np.lexsort((again, rows))
    again, rows = again[order], rows[order]
    later = again[np.flatnonzero(np.diff(rows, prepend=-1) == 0)]
    flags = np.zeros(len(text), dtype=bool)
    flags[later] = True
    return [flags[o : o + c] for o, c in zip(offsets, counts)]


def left_words(text: str, spans: list[list[int]]) -> tuple[list[bytes], int]:
    """The words that are left, and how many there were."""
    words = text.encode().split()
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for first, end in spans or []:
        edges[first] += 1
        edges[end + WIDTH - 1] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], len(words)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total, removed, sha = [], [], []
        for text, spans in zip(*(c.to_pylist() for c in batch.columns[1:])):
            words, n = left_words(text, spans)
            total.append(n)
            removed.append(n - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def with_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    repeats = Repeats(docs, UNITS, later_windows, True, id_col, text_col)
    met = meet_spans(docs, repeats.covered(), True, id_col, text_col)
    repeats.scratch.clear()  # the spans are stored
    return met


def later_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    clean, dirty, name = with_spans(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string"
    own = [quoted(id_col).alias("doc_id"), text_of(text_col).alias("text")]
    none = F.lit(None).cast("array<array<bigint>>").alias("spans")
    rows = clean.select(*own, none).unionByName(dirty.select(*own, quoted(name).alias("spans")))
    return rows.mapInArrow(digest_batches, schema)


def drop_later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out; what is left is joined by spaces in
    the texts that lose words."""
    clean, dirty, name = with_spans(docs, id_col, text_col)
    names = docs.columns
    place, width = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column(place).to_pylist(), batch.column(width).to_pylist())
            texts = [b" ".join(left_words(t, s)[0]).decode() if s else t for t, s in pairs]
            arrays = list(batch.columns[:width])
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return clean.unionByName(dirty.mapInArrow(run, T.StructType(docs.schema.fields)))
