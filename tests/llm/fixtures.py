"""Small tables with the cases that every operator defines a result for."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, and one that differs in case only.
CLASHING = ("maybe", "tag", "spans", "Word", "mask", "digest", "words", "kept", "k0", "text_sha256")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(vocabulary)}é" if rnd.random() < 0.1 else f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + ("\n" if i % 9 == 8 else " ") for i, w in enumerate(words))


def odd_rows() -> list[tuple]:
    """(doc_id, text, source) rows: nulls, empty and long texts, ties, repeated rows."""
    shared = prose(1, 120)
    near = shared.split(" ")
    near[5] = "other"
    rows = [
        (1, shared, "a"),
        (2, shared, "b"),
        (3, " ".join(near), None),
        (4, prose(2, 60) + shared + prose(3, 40), "a"),
        (5, None, "a"),
        (6, "", None),
        (7, " \t\n ", "c"),
        (8, "one two three", "c"),
        (9, "one two three", "ü"),
        (10, "x" * 5000, "a"),
        (11, "tick tock " * 300, "b"),
        (12, prose(4, 20_000), "a"),
        (13, "SHOUT!! " * 30, "a"),
        (14, "| a | b |\n" * 40, "b"),
        (15, "\x85\xa0　naïve 中文 \U0001f642 <|endoftext|> it's 1²", "b"),
        (None, shared, "a"),
        (None, "without an id " * 12, None),
        (None, "without an id " * 12, None),
        (16, "repeated row " * 15, "a"),
        (16, "repeated row " * 15, "a"),
        (17, "tie " + shared, "a"),
        (17, "tie two " + prose(9, 50), "a"),
    ]
    return rows


def table(spark, rows: list[tuple]):
    extra = tuple(f"x{i}" for i in range(len(CLASHING)))
    data = [(d, t, "en", s, None if t is None else len(t), *extra) for d, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


def odd_table(spark):
    return table(spark, odd_rows()).repartition(3)


def empty_table(spark):
    return table(spark, [])


def sample_rows(spark) -> list[tuple]:
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
