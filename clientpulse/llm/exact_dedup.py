"""Exact dedup: two passes over a Bloom filter, then grouping of what it leaves.

Pass one counts, for every probe position of every text hash, how often it is
hit, and keeps the positions hit twice or more as a bitmap. Pass two reads the
rows again: a row with any position hit once is the only one of its text and
passes straight through; the others are possible copies, and only they are
shuffled, by their SHA-256. False positives cost a shuffled row, never a result.

The bitmap is bounded (``bitmap.py``). A corpus beyond it fills it up and more rows
take the second path; results stay the same.

Defined cases: a null text counts as an empty one; all empty texts are copies of
each other. Null ids are smaller than any id; a group of null ids only keeps a
null id. Of rows that agree in text and id one stays. Other columns, whatever
their names, do not matter and come along in ``drop_copies``. Empty tables give
empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.bitmap import bitmap_bits, marked, repeated_bitmap, text_keys
from clientpulse.llm.common import fresh, quoted, text_of

def possible_copies(docs: DataFrame, text: Column, flag: str) -> DataFrame:
    """``docs`` with ``flag``: false only where no other row has the same text."""
    bits = bitmap_bits(docs.count())
    keys = text_keys(text)
    return marked(docs, keys, repeated_bitmap(docs, keys, bits), bits, flag)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    flagged = possible_copies(rows, F.col("text"), "maybe")
    digest = F.sha2(F.col("text"), 256).alias("text_sha256")
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest
    )
    # one row per text and id, combined before the shuffle, however large the group
    same = (
        flagged.where("maybe").select("doc_id", digest).groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    )
    groups = same.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    grouped = (
        same.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id stays."""
    flag, digest, row = fresh(docs.columns, "maybe", "digest", "row")
    flagged = possible_copies(docs, text_of(text_col), flag)
    columns = [quoted(c) for c in docs.columns]
    alone = flagged.where(~quoted(flag)).select(*columns)
    order = F.struct(quoted(id_col), F.xxhash64(*columns))
    best = (
        flagged.where(quoted(flag))
        .groupBy(F.sha2(text_of(text_col), 256).alias(digest))
        .agg(F.max_by(F.struct(*columns), order).alias(row))
        .select(F.col(f"{row}.*"))
    )
    return alone.unionByName(best)
