"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). Counting
joins the texts' SHA-256 and the SHA-256 of the tokenizer file to it, encodes one
text of each digest that is missing, and appends the new counts; all rows then take
their count from the cache. A text that occurs a million times is encoded once, and
only its digest and one copy per task are shuffled.

The count is the library's: special strings inside a text count as it takes them by
default, none are added, nothing is cut or padded. A piece of the split pattern met
before in the same Python worker is not encoded again (``MOST_PIECES``).

Normalised content is the text as it is, null as empty, as any other change could
change the count. Null and empty texts have 0 tokens. An append that a failed job
repeats leaves equal rows, which reading folds. An empty table gives an empty result
and an empty cache; extra columns, whatever their names, are not read."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.bpe import GPT_PATTERN, MOST_PIECES, ship, splitter
from clientpulse.llm.common import Scratch, quoted, slices, text_of

LIMIT = 512
CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"


class PieceCounter:
    """Counts of the library ``tokenizers``, remembered by piece where its model splits
    texts by the known pattern and changes nothing before."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        kind = type(self.model.pre_tokenizer).__name__
        self.by_piece = self.model.normalizer is None and kind == "ByteLevel" and not self.model.pre_tokenizer.add_prefix_space
        self.special = added
        self.split = splitter(GPT_PATTERN)
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.by_piece or any(s in text for s in self.special):
            return self.whole([text])[0]
        pieces = self.split(text)
        known = self.known
        new = {p for p in pieces if p not in known}
        if new:
            if len(known) + len(new) > MOST_PIECES:
                known.clear()
                new = set(pieces)
            known.update(zip(new, self.whole(list(new))))
        return sum(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def piece_counter(name: str) -> PieceCounter:
    """One per Python worker."""
    return PieceCounter(SparkFiles.get(name))


def count_batches(name: str, tokenizer_digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [piece_counter(name).count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tokenizer_digest] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_tokens"],
            )

    return run


def read_cache(spark, cache_path: str, tokenizer_digest: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, each digest once."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    own = stored.where(F.col("tokenizer_digest") == tokenizer_digest)
    return own.groupBy(F.col("content_digest").alias("digest")).agg(F.min("n_tokens").alias("n_tokens"))


def update_cache(texts: DataFrame, cache_path: str, tokenizer_path: str) -> str:
    """Encode the distinct texts that the cache lacks and append their counts; the
    digest of the tokenizer."""
    spark = texts.sparkSession
    with open(tokenizer_path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    name = ship(spark, tokenizer_path)
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").parquet(cache_path)
    cached = read_cache(spark, cache_path, version).select("digest")
    keyed = texts.select(F.sha2("text", 256).alias("digest"), "text")
    # one text per digest leaves each task
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(cached, "digest", "left_anti").select("digest", "text")
    misses.mapInArrow(count_batches(name, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return version


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Without
    ``cache_path`` the cache is a new one in the shared folder."""
    spark = docs.sparkSession
    path = cache_path or Scratch(spark, "token-cache").path()
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    version = update_cache(rows, path, tokenizer_path)
    keys = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    counts = read_cache(spark, path, version)
    return keys.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
