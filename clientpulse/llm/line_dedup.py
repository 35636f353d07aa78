"""Line dedup by overlapping windows of three lines.

The lines of a document that hold a word are hashed and taken three at a time. A
window is repeated if an equal one starts earlier: in a smaller doc_id (null last), or
before in the same document. Every line covered by a repeated window goes, found by
merging the covered positions of a document; blank lines and all others stay.

A window's first place is a minimum per hash, combined before the shuffle, and joined
back, so a passage that many documents share is never one group. Only documents with
repeated windows meet their texts again; a bitmap lets the others pass straight.

Defined cases: null and empty texts have no lines; fewer than three lines with words
have no window. Lines are compared unchanged, white space included. Rows that agree
in id and text are one document and treated alike; of other ties in id the one with
the smaller text hash is first. Extra columns, whatever their names, come along in
``drop_repeated_lines``. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.bitmap import bitmap_bits, marked, meet_spans, repeated_bitmap, text_keys
from clientpulse.llm.common import Scratch, quoted, text_of

WINDOW = 3
WORDY = r"[^\x20\x09-\x0D]"


def wordy_lines(text: Column) -> Column:
    """The lines with a word and their numbers among all lines."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    return F.filter(numbered, lambda x: x["line"].rlike(WORDY))


def window_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k0, k1, at, covers, h0, h1): two hashes of each window, its place and the
    numbers of its lines."""
    k0, k1 = text_keys(text_of(text_col))
    lines = docs.select(
        quoted(id_col).alias("doc_id"), k0.alias("k0"), k1.alias("k1"), wordy_lines(text_of(text_col)).alias("lines")
    ).where(F.size("lines") >= WINDOW)

    def hashes(x: Column) -> Column:
        return F.struct(x["i"].alias("i"), *(F.xxhash64(F.lit(j), x["line"]).alias(f"h{j}") for j in range(2)))

    hashed = lines.select("doc_id", "k0", "k1", F.transform("lines", hashes).alias("h"))

    def window(at: Column) -> Column:
        three = [F.element_at("h", at + j) for j in range(WINDOW)]
        return F.struct(
            at.alias("at"),
            F.array(*(x["i"] for x in three)).alias("covers"),
            F.xxhash64(*(x["h0"] for x in three)).alias("h0"),
            F.xxhash64(*(x["h1"] for x in three)).alias("h1"),
        )

    return hashed.select(
        "doc_id", "k0", "k1", F.inline(F.transform(F.sequence(F.lit(1), F.size("h") - WINDOW + 1), window))
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k0, k1, spans): the line numbers of each repeated window."""
    scratch = Scratch(docs.sparkSession, "lines")
    windows = scratch.keep(window_table(docs, id_col, text_col))
    bits = bitmap_bits(windows.count())
    keys = [F.col("h0"), F.col("h1")]
    several = marked(windows, keys, repeated_bitmap(windows, keys, bits), bits, "maybe").where("maybe")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k0", "k1", "at")
    first = several.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = several.join(first, ["h0", "h1"]).where(~place.eqNullSafe(F.col("first")))
    own = later.select("doc_id", "k0", "k1", "covers").distinct()
    return own.groupBy("doc_id", "k0", "k1").agg(F.collect_list("covers").alias("spans"))


def kept_text(text: Column, spans: Column) -> Column:
    """The text without the lines that the windows cover."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(spans))
    return F.when(spans.isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
    )


def met(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    return meet_spans(docs, repeated_lines(docs, id_col, text_col), True, id_col, text_col)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (with words), n_removed, kept_sha256."""
    clean, dirty, name = met(docs, id_col, text_col)

    def row(spans: Column) -> list[Column]:
        text = text_of(text_col)
        return [
            quoted(id_col).alias("doc_id"),
            F.size(wordy_lines(text)).cast("long").alias("n_lines"),
            F.coalesce(F.size(F.array_distinct(F.flatten(spans))), F.lit(0)).cast("long").alias("n_removed"),
            F.sha2(kept_text(text, spans), 256).alias("kept_sha256"),
        ]

    return clean.select(*row(F.lit(None).cast("array<array<int>>"))).unionByName(dirty.select(*row(quoted(name))))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later occurrences of repeated windows."""
    clean, dirty, name = met(docs, id_col, text_col)
    columns = [
        F.when(quoted(name).isNull(), quoted(c)).otherwise(kept_text(text_of(c), quoted(name))).alias(c)
        if c == text_col
        else quoted(c)
        for c in docs.columns
    ]
    return clean.unionByName(dirty.select(*columns))
