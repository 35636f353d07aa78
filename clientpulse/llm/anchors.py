"""Finding repeated windows of a corpus: sampling, segments, and the way back to rows.

A window is ``width`` consecutive units (bytes or words) of one document. Of the
grams of ``gram`` units inside a window the one with the smallest hash, leftmost of
equals, is its anchor. Equal windows have equal anchors at equal places, so windows
need only be compared with windows of the same anchor hash. Consecutive windows with
one anchor form a run; the units they cover are its segment. That makes about one
small row for every (width - gram) / 2 units instead of one for every unit.

Equal segments are counted, not compared: one of them, the first, stands for all.
Anchors that occur once are dropped with the help of a bounded bitmap. Segments of
anchors with several different segments are fetched and dealt by anchor to shards,
whose index (a suffix array, an FM-index) says which windows are found elsewhere. An
anchor with over ``MOST_SEGMENTS`` different segments would be a hot group: its
windows go by their own hashes instead, counted before the shuffle, so no task gets
a group without bound.

Rows that agree in id and text are the same place in the order of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.bitmap import bitmap_bits, marked, repeated_bitmap, set_bitmap, text_keys
from clientpulse.llm.common import Scratch, quoted, slices, text_of
from clientpulse.llm.hashing import BYTE_VALUES, STEP, mix, prefix_sums, run_hashes, word_bounds

MOST_SEGMENTS = 4096
SHARD_BYTES = 2_000_000
PLACE_BITS = 24
CHUNK = 1 << 22


@dataclass(frozen=True)
class Units:
    """Bytes or words of a text, and the windows over them."""

    words: bool
    width: int
    gram: int

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each unit, and its hash."""
        data = np.frombuffer(raw, dtype=np.uint8)
        if not self.words:
            at = np.arange(len(data) + 1)
            return at[:-1], at[1:], BYTE_VALUES[data]
        starts, ends = word_bounds(data)
        return starts, ends, mix(run_hashes(prefix_sums(BYTE_VALUES[data]), starts, ends))

    def runs(self, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, segment hash, first window, windows, place of the anchor) of each run."""
        n, k = len(sums) - 1, self.gram
        span = self.width - k + 1
        windows = n - self.width + 1
        found = []
        for low in range(0, max(windows, 0), CHUNK):
            high = min(low + CHUNK, windows)
            at = np.arange(low, high + span - 1)
            grams = run_hashes(sums, at, at + k)
            mask = np.uint64((1 << PLACE_BITS) - 1)
            packed = (grams & ~mask) | np.arange(len(at), dtype=np.uint64)
            place = (sliding_min(packed, span) & mask).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            count = np.diff(first, append=len(place))
            anchor = place[first]
            begin, end = first + low, first + low + count - 1 + self.width
            segment = mix(run_hashes(sums, begin, end) ^ ((anchor - first).astype(np.uint64) * STEP))
            found.append((grams[anchor], segment, begin, count, anchor - first))
        if not found:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(part) for part in zip(*found))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def run_batches(units: Units):
    """Runs of (doc_id, k0, k1, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts, index = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = units.runs(prefix_sums(units.read(text.encode())[2]))
                parts.append(found)
                index.append(np.full(len(found[0]), i))
            if not parts:
                continue
            anchor, segment, first, count, place = (np.concatenate(p) for p in zip(*parts))
            own = batch.select([0, 1, 2]).take(pa.array(np.concatenate(index)))
            arrays = [*own.columns, signed(anchor), signed(segment), pa.array(first), pa.array(count), pa.array(place)]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["doc_id", "k0", "k1", "anchor", "segment", "first", "n", "place"]
            )

    return run


def fetch_batches(units: Units):
    """Contents of (text, wanted) rows: the segments as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py().encode()
                starts, ends, _ = units.read(raw)
                rows = [(w["anchor"], w["segment"], raw[starts[w["first"]] : ends[w["first"] + w["n"] + units.width - 2]]) for w in wanted]
                a, s, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(c, pa.binary())],
                    names=["anchor", "segment", "content"],
                )

    return run


def window_batches(units: Units):
    """(anchor, segment, window, h0, h1) of each window of (anchor, segment, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for anchor, segment, content in zip(*(c.to_pylist() for c in batch.columns)):
                values = units.read(content)[2]
                at = np.arange(len(values) - units.width + 1)
                h0 = run_hashes(prefix_sums(values), at, at + units.width)
                h1 = run_hashes(prefix_sums(mix(values + STEP)), at, at + units.width)
                same = np.full(len(at), 1, dtype=np.int64)
                arrays = [pa.array(same * anchor), pa.array(same * segment), pa.array(at), signed(h0), signed(h1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "segment", "window", "h0", "h1"])

    return run


#: A shard's index: (contents, anchor places, window counts, occurrences, sizes of the
#: anchors' groups) of segments sorted by anchor and place -> windows found, per segment.
Index = Callable[[list[bytes], list[int], list[int], list[int], list[int]], list[np.ndarray]]


def shard_batches(index: Index):
    """Feed whole anchor groups of a sorted partition to the index, ``SHARD_BYTES`` at a
    time, and give the found windows as intervals."""

    def flush(held: list[dict]) -> pa.RecordBatch:
        sizes, last = [], None
        for row in held:
            if row["anchor"] == last:
                sizes[-1] += 1
            else:
                sizes.append(1)
                last = row["anchor"]
        found = index(*([r[k] for r in held] for k in ("content", "place", "n", "times")), sizes)
        spans = [intervals(f) for f in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["anchor"] for r in held], pa.int64()),
                pa.array([r["segment"] for r in held], pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            ],
            names=["anchor", "segment", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for row in batch.to_pylist():
                if size >= SHARD_BYTES and row["anchor"] != held[-1]["anchor"]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["content"])
        if held:
            yield flush(held)

    return run


def intervals(flags: np.ndarray) -> list[list[int]]:
    """[first, end) of the runs of set flags."""
    edge = np.diff(np.concatenate([[0], np.asarray(flags, dtype=np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()


class Repeats:
    """Repeated windows of the texts of a table.

    With ``ordered`` a window counts where an equal one starts earlier (in a smaller
    doc_id, null last, or before in the same document), else where an equal one starts
    anywhere else."""

    def __init__(self, docs: DataFrame, units: Units, index: Index, ordered: bool, id_col: str, text_col: str):
        self.units, self.index, self.ordered = units, index, ordered
        self.scratch = Scratch(docs.sparkSession, "windows")
        k0, k1 = text_keys(text_of(text_col))
        self.texts = docs.select(
            quoted(id_col).alias("doc_id"), k0.alias("k0"), k1.alias("k1"), text_of(text_col).alias("text")
        )
        self.id_type = docs.schema[id_col].dataType.simpleString()

    def covered(self) -> DataFrame:
        """(doc_id, k0, k1, spans): per document the intervals of its repeated windows. Reads
        scratch tables; ``scratch.clear`` frees them once the result is stored."""
        keep = self.scratch.keep
        schema = f"doc_id {self.id_type}, k0 bigint, k1 bigint, anchor bigint, segment bigint, first bigint, n bigint, place bigint"
        runs = keep(self.texts.mapInArrow(run_batches(self.units), schema))
        bits = bitmap_bits(runs.count())
        keys = [F.col("anchor"), F.xxhash64("anchor")]
        met = marked(runs, keys, repeated_bitmap(runs, keys, bits), bits, "maybe").where("maybe")
        where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k0", "k1", "first")
        segments = keep(
            met.groupBy("anchor", "segment", "n", "place").agg(F.min(where).alias("at"), F.count("*").alias("times"))
        )
        groups = segments.groupBy("anchor").agg(F.count("*").alias("kinds"))
        several = keep(segments.join(groups.where("kinds > 1"), "anchor"))
        few, hot = several.where(F.col("kinds") <= MOST_SEGMENTS), several.where(F.col("kinds") > MOST_SEGMENTS)
        indexed = self.by_index(few)
        done, found = [segments, several, indexed], indexed
        if not hot.isEmpty():
            windows = self.windows(hot)
            done.append(windows)
            found = found.unionByName(self.by_window(windows))
        found = found.where(F.size("spans") > 0)
        whole = F.array(F.array(F.lit(0).cast("bigint"), F.col("n")))
        if self.ordered:
            # all but the first of equal segments are repeated as a whole
            judged = segments.join(found, ["anchor", "segment"], "left").where("times > 1 or spans is not null")
        else:
            again = segments.where("times > 1").select("anchor", "segment", whole.alias("spans"))
            once = found.join(segments.where("times = 1").select("anchor", "segment"), ["anchor", "segment"])
            judged = again.unionByName(once).withColumn("at", F.lit(None))
        judged = keep(judged.select("anchor", "segment", "at", "spans"))
        self.scratch.drop(*done)  # the way back to rows reads only runs and judged segments
        bits = bitmap_bits(judged.count())
        keys = [F.col("anchor"), F.col("segment")]
        hit = marked(runs, keys, set_bitmap(judged, keys, bits), bits, "maybe").where("maybe")
        joined = hit.join(judged, ["anchor", "segment"])
        if self.ordered:
            mine = F.when(where.eqNullSafe(F.col("at")), F.col("spans")).otherwise(whole)
            joined = joined.withColumn("spans", mine).where("spans is not null")
        moved = F.transform("spans", lambda s: F.transform(s, lambda x: x + F.col("first")))
        spans = joined.select("doc_id", "k0", "k1", F.explode(moved).alias("span"))
        if not self.ordered:
            # copies of a text have the same spans: they are gathered once
            spans = spans.select("k0", "k1", "span").distinct()
            return spans.groupBy("k0", "k1").agg(F.collect_list("span").alias("spans"))
        # rows that agree in id and text are one document
        return spans.distinct().groupBy("doc_id", "k0", "k1").agg(F.collect_list("span").alias("spans"))

    def contents(self, segments: DataFrame) -> DataFrame:
        """(anchor, segment, content). Only texts that hold a wanted segment are shuffled."""
        wanted = segments.groupBy(F.col("at.k0").alias("k0"), F.col("at.k1").alias("k1")).agg(
            F.collect_list(F.struct("anchor", "segment", F.col("at.first").alias("first"), "n")).alias("wanted")
        )
        keys = [F.col("k0"), F.col("k1")]
        places = segments.select(F.col("at.k0").alias("k0"), F.col("at.k1").alias("k1")).distinct()
        bits = bitmap_bits(places.count())
        near = marked(self.texts.drop("doc_id"), keys, set_bitmap(places, keys, bits), bits, "maybe").where("maybe")
        texts = near.groupBy("k0", "k1").agg(F.first("text").alias("text"))
        rows = texts.join(wanted, ["k0", "k1"]).select("text", "wanted")
        return rows.mapInArrow(fetch_batches(self.units), "anchor bigint, segment bigint, content binary")

    def by_index(self, segments: DataFrame) -> DataFrame:
        """(anchor, segment, spans) by a shard's index."""
        order = ["anchor", *(f"at.{c}" for c in ("no_id", "doc_id", "k0", "k1", "first"))]
        rows = self.contents(segments).join(segments.drop("kinds"), ["anchor", "segment"])
        n = segments.sparkSession.conf.get("spark.sql.shuffle.partitions")
        dealt = rows.repartition(int(n), "anchor").sortWithinPartitions(*order)
        return self.scratch.keep(
            dealt.select("anchor", "segment", "content", "place", "n", "times").mapInArrow(
                shard_batches(self.index), "anchor bigint, segment bigint, spans array<array<bigint>>"
            )
        )

    def windows(self, segments: DataFrame) -> DataFrame:
        """Each window of the segments of hot anchors, with its hashes."""
        schema = "anchor bigint, segment bigint, window bigint, h0 bigint, h1 bigint"
        return self.scratch.keep(
            self.contents(segments)
            .mapInArrow(window_batches(self.units), schema)
            .join(segments.select("anchor", "segment", "at", "times"), ["anchor", "segment"])
        )

    def by_window(self, windows: DataFrame) -> DataFrame:
        """The same as ``by_index`` for hot anchors, by the hashes of their single windows."""
        at = F.struct(*(F.col(f"at.{c}").alias(c) for c in ("no_id", "doc_id", "k0", "k1")), F.col("at.first") + F.col("window"))
        placed = windows.withColumn("place", at)
        met = placed.groupBy("h0", "h1").agg(F.sum("times").alias("total"), F.min("place").alias("earliest"))
        both = placed.join(met.where("total > 1"), ["h0", "h1"])
        if self.ordered:
            both = both.where(~F.col("place").eqNullSafe(F.col("earliest")))
        one = F.array(F.col("window"), F.col("window") + 1)
        return both.groupBy("anchor", "segment").agg(F.collect_list(one).alias("spans"))
