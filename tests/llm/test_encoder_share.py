"""The pipeline's encoder keeps less than a whole one and gives the same ids."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from clientpulse.llm import bpe


def test_a_share_of_the_caches_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 400)
    monkeypatch.setattr(bpe, "MOST_PIECES", 50)
    with open(corpus_pipeline.RANKS, "rb") as lines:
        ranks = bpe.read_ranks(lines)
    whole, part = (bpe.Encoder(ranks, public_tokenizers.PATTERN, share) for share in (1.0, corpus_pipeline.ENCODER_SHARE))
    for i in range(300):
        text = f"word{i} unusualness{i * 7919} ünïcode{i} zzxqv{i % 17}"
        assert whole.encode(text) == part.encode(text)
        assert len(part.transducer.states) <= 81 and len(part.known) <= 10


def test_idle_workers_keep_no_encoder_of_a_share(spark):
    docs = spark.createDataFrame([(i, f"some words, and number {i * i}") for i in range(40)], "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def left(batches):
        from clientpulse.llm import bpe as of_worker

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([of_worker.encoder.cache_info().currsize], pa.int32())], names=["n"])

    def kept():
        return {r.n for r in docs.mapInArrow(left, "n int").collect()}

    part = bpe.digest_table(docs, path, public_tokenizers.PATTERN, share=0.2)
    found = {tuple(r) for r in part.collect()}
    assert kept() == {0}
    whole = {tuple(r) for r in bpe.digest_table(docs, path, public_tokenizers.PATTERN).collect()}
    assert found == whole and len(found) == 40
