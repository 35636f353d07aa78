"""A bounded bitmap over text keys, tested inside a scan by a broadcast join.

It lets most rows of a large table skip a shuffle: a row whose key is in a set is
always marked, others seldom. It has ``BITS_PER_KEY`` bits a key and at most
``MOST_BITS``, 64 to a row, so at most a million rows of two longs are broadcast.
Beyond that it fills up and marks more rows; no result depends on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.common import Scratch, fresh, quoted, text_of

BITS_PER_KEY = 32
MOST_BITS = 1 << 26
LEAST_BITS = 1 << 16


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes, which together name a text."""
    return [F.xxhash64(F.lit(0), text), F.xxhash64(F.lit(1), text)]


def bitmap_bits(n_keys: int) -> int:
    """A power of two, so that positions are masks of a hash."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n_keys * BITS_PER_KEY) - 1).bit_length()))


def positions(keys: Sequence[Column], bits: int) -> list[Column]:
    return [key.bitwiseAND(F.lit(bits - 1)) for key in keys]


def words_of(hits: DataFrame) -> DataFrame:
    """(word, mask) of a table of distinct positions."""
    return hits.groupBy(F.expr("shiftright(position, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(position & 63 AS int))")).alias("mask")
    )


def repeated_bitmap(rows: DataFrame, keys: Sequence[Column], bits: int) -> DataFrame:
    """Positions that are hit more than once."""
    hits = rows.select(F.explode(F.array(*positions(keys, bits))).alias("position"))
    return words_of(hits.groupBy("position").agg(F.count("*").alias("n")).where("n > 1"))


def set_bitmap(rows: DataFrame, keys: Sequence[Column], bits: int) -> DataFrame:
    """Positions that are hit at all."""
    return words_of(rows.select(F.explode(F.array(*positions(keys, bits))).alias("position")).distinct())


def marked(rows: DataFrame, keys: Sequence[Column], bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with ``flag``: are all positions of the row's keys set?"""
    out, hit = rows, F.lit(True)
    for position in positions(keys, bits):
        word, mask = fresh(out.columns, "word", "mask")
        side = bitmap.select(F.col("word").alias(word), F.col("mask").alias(mask))
        # bounded: at most MOST_BITS / 64 rows of two longs
        out = out.join(F.broadcast(side), F.shiftright(position, 6) == quoted(word), "left")
        bit = F.call_function("shiftright", quoted(mask), position.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        hit = hit & quoted(mask).isNotNull() & (bit == 1)
    return out.select(*(quoted(c) for c in rows.columns), F.coalesce(hit, F.lit(False)).alias(flag))


def meet_spans(
    docs: DataFrame, spans: DataFrame, by_id: bool, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``docs`` without repeats, and the others with the ``spans`` of their
    repeats in a column of the returned name. Only rows that the bitmap marks are
    shuffled."""
    spans = Scratch(docs.sparkSession, "spans").keep(spans)
    bits = bitmap_bits(spans.count())
    keys = text_keys(text_of(text_col))
    flag, own_id, s0, s1, name = fresh(docs.columns, "maybe", "own_id", "s0", "s1", "spans")
    flagged = marked(docs, keys, set_bitmap(spans, [F.col("k0"), F.col("k1")], bits), bits, flag)
    columns = [quoted(c) for c in docs.columns]
    clean = flagged.where(~quoted(flag)).select(*columns)
    same = (keys[0] == F.col(s0)) & (keys[1] == F.col(s1))
    side = spans.withColumnsRenamed({"k0": s0, "k1": s1, "spans": name})
    if by_id:
        side = side.withColumnRenamed("doc_id", own_id)
        same = same & quoted(id_col).eqNullSafe(F.col(own_id))
    dirty = flagged.where(quoted(flag)).join(side, same, "left").select(*columns, name)
    return clean, dirty, name
