"""Mixing sources to target weights, by blocks drawn through index permutations.

The words of a source, its documents in a hashed order, are packed into blocks of
``BLOCK_WORDS``. A source with ``n`` blocks and ``S`` words whose target is ``T``
words gets ``round(n * T / S)`` slots. Its slots are dealt to the output shards by a
multinomial draw of its own, so that the counts of a shard are random while every
source's total is exact. Slot ``j`` takes block ``permute(j mod n)`` of pass
``j div n``: each pass is a fresh keyed Feistel permutation of the indices, so all
blocks are used before one is used again. Slots and blocks meet in a join by index.

Targets: all sources share the corpus's words by weight; a target stops at
``MOST_TIMES`` times its source's words, and the excess is shared again by weight.
With at most that many passes no block, and so no document, is taken more often.

Draws and permutations depend on the seed and the indices only, and documents are
ordered by hashes of id and text, so reruns and retried tasks agree.

Defined cases: null and empty texts have no words and are taken 0 times; a null
source is a source of its own and ranks last; null ids are ids like others. Equal
rows are told apart by a row tag, which is fixed by writing it. An empty table gives
an empty result. Extra columns, whatever their names, come along in ``mixed``."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientpulse.llm.common import Scratch, SPACE_RUN, fresh, quoted, slices, text_of

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 8192
BUCKET_ROWS = 4_000
SEED = 7
ROUNDS = 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE_RUN), "")).cast("long")


# --- targets ---------------------------------------------------------------------


def ranked(table: DataFrame, key: str, rank: str, scratch: Scratch) -> DataFrame:
    """Add the rank of ``key`` from 0, nulls last, without one sort of all rows: ranges
    are ranked alone, and the row counts of the ranges before (one row each) are added."""
    order = [F.col(key).isNull(), F.col(key)]
    parts = table.sparkSession.sparkContext.defaultParallelism
    ranged = scratch.keep(table.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range").orderBy(*order)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = ranged.withColumn("__inside", F.row_number().over(within) - 1)
    # bounded: one row per range
    joined = inside.join(F.broadcast(offsets), "__range")
    return joined.select(*(quoted(c) for c in table.columns), (F.col("__inside") + F.col("__before")).alias(rank))


def targets(sources: DataFrame, most: int = MOST_TIMES) -> DataFrame:
    """``sources`` (words, weight) with ``target``. Each round fetches three sums."""
    total = sources.agg(F.sum("words")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("words") * most < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(over, F.col("words") * most)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("weights"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row.n == capped or not row.weights:
            break
        level, capped = (total - (row.fixed or 0)) / row.weights, row.n
    full = (F.col("words") * most).cast("double")
    return sources.withColumn("target", F.least(full, F.lit(float(level)) * F.col("weight")))


def source_plan(rows: DataFrame, scratch: Scratch, weights: Sequence[int], block_words: int) -> DataFrame:
    """(source, src, words, n_rows, target, blocks, slots), one row per source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n_rows"))
    numbered = ranked(sizes, "source", "src", scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    table = targets(scratch.keep(numbered.withColumn("weight", weight)))
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    slots = F.when(F.col("words") > 0, F.floor(F.col("target") * blocks / F.col("words") + 0.5)).otherwise(0).cast("long")
    return scratch.keep(
        table.select("source", "src", "words", "n_rows", "target", blocks.alias("blocks"), slots.alias("slots"))
    )


# --- blocks ----------------------------------------------------------------------


def placed(rows: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row's first word index within its source. A source is cut by hash into
    buckets of about ``BUCKET_ROWS``, so a hot one is many groups."""
    n_buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS).cast("long")
    side = plan.select(
        F.col("source").alias("s"), "src", F.col("words").alias("source_size"), "target", n_buckets.alias("n_buckets")
    )
    keyed = rows.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "order"), F.col("n_buckets")))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("src", "bucket")
        .agg(F.sum("size").alias("n"))
        .select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("src", "bucket")
        .orderBy("order", "doc_id", "order2", "tag")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    started = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return scratch.keep(
        started.join(offsets, ["src", "bucket"]).select(
            "tag", "doc_id", "src", "size", "source_size", "target", (F.col("inside") + F.col("offset")).alias("start")
        )
    )


def pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """(tag, src, block, first, words): the parts of documents in each block."""
    end = F.col("start") + F.col("size")
    spread = rows.where("size > 0").withColumn(
        "block",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long")
            )
        ),
    )
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(end, (F.col("block") + 1) * block_words)
    return spread.select("tag", "src", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))


def permute(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """The images of ``index`` under a permutation of 0..n-1: a Feistel network over the
    next even number of bits, applied again where it leaves the range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, ROUNDS, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw_shards(seed: int, n_shards: int):
    """Per source, how many of its slots each shard gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                rng = np.random.default_rng((seed, row["src"]))
                counts = rng.multinomial(row["slots"], np.full(n_shards, 1 / n_shards))
                first = np.cumsum(counts) - counts
                used = np.flatnonzero(counts)
                n = len(used)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["src"], dtype=np.int64)),
                        pa.array(np.full(n, row["blocks"], dtype=np.int64)),
                        pa.array(used.astype(np.int64)),
                        pa.array(first[used].astype(np.int64)),
                        pa.array(counts[used].astype(np.int64)),
                    ],
                    names=["src", "blocks", "shard", "first", "n"],
                )

    return run


def map_slots(seed: int):
    """The block of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                slot = np.arange(row["first"], row["first"] + row["n"], dtype=np.int64)
                turn, index = slot // row["blocks"], slot % row["blocks"]
                block = np.empty_like(index)
                for t in np.unique(turn):
                    at = turn == t
                    block[at] = permute(index[at], row["blocks"], (seed, row["src"], int(t)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slot), row["src"], dtype=np.int64)),
                        pa.array(block),
                        pa.array(np.full(len(slot), row["shard"], dtype=np.int64)),
                        pa.array(slot),
                    ],
                    names=["src", "block", "shard", "slot"],
                )

    return run


def slots(plan: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(src, block, shard, slot): which block each output slot holds."""
    total = plan.agg(F.sum("slots")).first()[0] or 0
    n_shards = max(1, -(-total // shard_slots))
    chosen = plan.where("slots > 0").select("src", "blocks", "slots")
    parts = max(plan.sparkSession.sparkContext.defaultParallelism, n_shards // 8)
    chunks = chosen.mapInArrow(
        draw_shards(seed, n_shards), "src bigint, blocks bigint, shard bigint, first bigint, n bigint"
    ).repartition(parts, "src", "shard")
    return chunks.mapInArrow(map_slots(seed), "src bigint, block bigint, shard bigint, slot bigint")


def tagged_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, tag: Column) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        tag.alias("tag"),
        quoted(id_col).alias("doc_id"),
        quoted(source_col).alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(quoted(id_col), text).alias("order"),
        F.xxhash64(F.lit(1), text).alias("order2"),
    )


def picked_pieces(rows: DataFrame, scratch: Scratch, weights, block_words) -> tuple[DataFrame, DataFrame]:
    plan = source_plan(rows, scratch, weights, block_words)
    starts = placed(rows, plan, scratch)
    # mapInArrow hides how many slots a small plan becomes; without the hint they would be broadcast
    times = slots(plan).groupBy("src", "block").agg(F.count("*").alias("times")).hint("merge")
    return starts, pieces(starts, block_words).join(times, ["src", "block"])


def mix_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words)."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(tagged_rows(docs, id_col, text_col, source_col, F.monotonically_increasing_id()))
    starts, picked = picked_pieces(rows, scratch, weights, block_words)
    taken = picked.groupBy("tag").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return starts.join(taken, "tag", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def cut_texts(text: str, parts: list[dict]) -> list[str]:
    """The text of each pass: the words whose block was taken at least so many times,
    each with the white space after it."""
    parts = sorted(parts, key=lambda p: p["first"])
    out = []
    starts: list[int] = []
    for turn in range(1, max(p["times"] for p in parts) + 1):
        if all(p["times"] >= turn for p in parts) and parts[0]["whole"]:
            out.append(text)
            continue
        if not starts:
            starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
        out.append("".join(text[starts[p["first"]] : starts[p["first"] + p["words"]]] for p in parts if p["times"] >= turn))
    return out


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix as rows like ``docs``: for each pass over a document one row with the
    words taken in it. Documents of which nothing is taken are absent."""
    scratch = Scratch(docs.sparkSession, "mix")
    (tag,) = fresh(docs.columns, "tag")
    stored = scratch.keep(docs.withColumn(tag, F.monotonically_increasing_id()))
    rows = scratch.keep(tagged_rows(stored, id_col, text_col, source_col, quoted(tag)))
    starts, picked = picked_pieces(rows, scratch, weights, block_words)
    whole = F.sum("words").over(Window.partitionBy("tag"))
    sized = picked.withColumn("got", whole).join(starts.select("tag", "size"), "tag")
    part = F.struct("first", "words", F.col("times").cast("int").alias("times"), (F.col("got") == F.col("size")).alias("whole"))
    parts_name, other_tag = fresh([*docs.columns, tag], "parts", "tag_of_parts")
    lists = sized.groupBy("tag").agg(F.collect_list(part).alias(parts_name)).withColumnRenamed("tag", other_tag)
    joined = stored.join(lists, quoted(tag) == F.col(other_tag)).drop(other_tag, tag)
    schema = T.StructType(docs.schema.fields)
    names = docs.columns
    place, width = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            parts = batch.column(width).to_pylist()
            index, cut = [], []
            for i, (text, own) in enumerate(zip(texts, parts)):
                made = cut_texts(text, own)
                index += [i] * len(made)
                cut += made
            rest = batch.select(range(width)).take(pa.array(index, pa.int64()))
            arrays = rest.columns
            arrays[place] = pa.array(cut, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, schema)
