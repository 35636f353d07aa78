"""Every stage of the pipeline against plain Python on its own input."""

from __future__ import annotations

from collections import Counter

import fixtures as fx
import plain
import public_tokenizers
import tiktoken

import corpus_pipeline
from clientpulse.llm import bpe


def test_stages_on_the_sample(spark):
    tables = [spark.read.parquet(f"{fx.SF}/documents.parquet")]
    columns = tables[0].columns
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], fx.SF).cache())
    docs, good, unique, distinct, mix, tokens = (t.collect() for t in tables)
    assert all(t.columns == columns for t in tables[:5])

    failed = {r.doc_id for r in docs if plain.base_counts(r.text)["base_failed"]}
    assert not failed & {r.doc_id for r in good}
    low = {r.doc_id for r in spark.read.parquet(f"{fx.SF}/labels.parquet").where("quality = 0").collect()}
    lost = {r.doc_id for r in docs} - failed - {r.doc_id for r in good}
    assert len(lost - low) <= 0.02 * len(docs)

    last: dict = {}
    for r in good:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert sorted(last.values()) == sorted(r.doc_id for r in unique)

    groups = plain.components([(r.doc_id, r.text) for r in unique])
    assert {c for _, c in groups.values()} == {r.doc_id for r in distinct}

    sizes: Counter = Counter()
    for r in distinct:
        sizes[r.source] += len(plain.words_of(r.text))
    taken: Counter = Counter()
    for r in mix:
        taken[r.source] += len(plain.words_of(r.text))
    for source, target in plain.mix_targets(sizes).items():
        assert abs(taken[source] - target) <= 128
    assert max(Counter(r.doc_id for r in mix).values()) <= 3

    with open(corpus_pipeline.RANKS, "rb") as lines:
        ranks = bpe.read_ranks(lines)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mix:
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(r.text)))
    assert sorted(want) == sorted(map(tuple, tokens))


def test_run_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    fx.odd_table(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 0
