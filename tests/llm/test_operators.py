"""Each operator against plain Python, on odd rows and on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import fixtures as fx
import plain
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientpulse.llm import anchors, bpe, exact_dedup, fm_index, line_dedup, minhash, mixing, quality, queries
from clientpulse.llm import suffix_dedup, token_counts


def whole(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    return fx.odd_table(spark).cache()


@pytest.fixture(scope="module")
def sample(spark):
    return fx.sample_rows(spark)


def same_columns(df, docs):
    assert df.columns == docs.columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]


# --- exact dedup ------------------------------------------------------------------


def expected_groups(rows):
    groups: dict = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep, left = max(known) if known else None, 1
        for d in ids:
            kept = d == keep and left == 1
            left -= kept
            out.append((d, keep, len(ids), kept, plain.sha(t)))
    return sorted(out, key=repr)


def test_copy_groups_of_odd_rows(odd):
    assert whole(exact_dedup.copy_groups(odd)) == expected_groups(fx.odd_rows())


def test_drop_copies_keeps_one_of_each_text(odd):
    left = exact_dedup.drop_copies(odd)
    same_columns(left, odd)
    want = {(keep, sha) for _, keep, _, _, sha in expected_groups(fx.odd_rows())}
    got = [(r.doc_id, plain.sha(r.text or "")) for r in left.collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_full_bitmap_changes_no_result(odd, monkeypatch):
    monkeypatch.setattr("clientpulse.llm.bitmap.MOST_BITS", 64)
    monkeypatch.setattr("clientpulse.llm.bitmap.LEAST_BITS", 64)
    assert whole(exact_dedup.copy_groups(odd)) == expected_groups(fx.odd_rows())


# --- repeated bytes, words and lines ---------------------------------------------------


def test_repeated_bytes_of_odd_rows(odd):
    rows = fx.odd_rows()
    want = [(d, *x) for (d, _, _), x in zip(rows, plain.removed_bytes([t for _, t, _ in rows]))]
    assert whole(suffix_dedup.repeat_table(odd)) == sorted(want, key=repr)


def test_repeated_bytes_of_the_sample(spark, sample):
    want = [(d, *x) for (d, _, _), x in zip(sample, plain.removed_bytes([t for _, t, _ in sample]))]
    assert whole(queries.QUERIES["op1_suffix_dedup"](spark, fx.SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("operator", [suffix_dedup, fm_index])
def test_scratch_of_windows_goes_once_spans_are_stored(spark, odd, monkeypatch, operator):
    roots, plain_init = [], anchors.Scratch.__init__

    def noted(self, *args):
        plain_init(self, *args)
        roots.append(Path(self.root))

    monkeypatch.setattr(anchors.Scratch, "__init__", noted)
    clean, dirty, _ = operator.with_spans(odd, "doc_id", "text")
    windows = [r for r in roots if r.name.startswith("windows")]
    assert windows and not any(r.exists() for r in windows)
    assert clean.count() + dirty.count() == odd.count()


@pytest.mark.parametrize("most", [4096, 1])
def test_hot_anchors_go_by_window_hashes(spark, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST_SEGMENTS", most)
    passage = fx.prose(50, 110)
    rows = [(i, fx.prose(100 + i, 30) + passage + fx.prose(200 + i, 30), "a") for i in range(12)]
    docs = fx.table(spark, rows)
    want = [(d, *x) for (d, _, _), x in zip(rows, plain.removed_bytes([t for _, t, _ in rows]))]
    assert whole(suffix_dedup.repeat_table(docs)) == sorted(want, key=repr)
    assert whole(fm_index.later_table(docs)) == sorted(plain.removed_words([r[:2] for r in rows]), key=repr)


def test_repeated_words_of_odd_rows(odd):
    # rows that agree in id and text are one document; ties in id and null ids follow hashes
    rows = [r[:2] for r in fx.odd_rows()]
    known = [(d, t) for d, t in dict.fromkeys(rows) if d is not None and d != 17]
    want = {x[0]: x for x in plain.removed_words(known)}
    got = fm_index.later_table(odd).collect()
    assert len(got) == len(rows)
    assert all(tuple(r) == want[r.doc_id] for r in got if r.doc_id in want)
    copies = [r for r in got if r.doc_id is None and r.n_words == 120]
    assert [r.n_removed for r in copies] == [120]


def test_repeated_words_of_the_sample(spark, sample):
    got = whole(queries.QUERIES["op8_substring_dedup"](spark, fx.SF))
    assert got == sorted(plain.removed_words([r[:2] for r in sample]), key=repr)


def test_operators_that_cut_keep_columns_and_rows(odd):
    rows = odd.count()
    for cut in (suffix_dedup.drop_repeats, fm_index.drop_later, line_dedup.drop_repeated_lines):
        left = cut(odd)
        same_columns(left, odd)
        assert left.count() == rows
    assert fm_index.drop_later(odd).where("doc_id = 1").first().text == fx.odd_rows()[0][1]
    assert suffix_dedup.drop_repeats(odd).where("doc_id = 1").first().text == ""


def test_lines_of_odd_rows(odd, spark):
    text = "a b\n\nc\nd\ne\n"
    docs = fx.table(spark, [(1, text, "a"), (2, "z\n" + text, "a"), (3, None, "a"), (4, "c\nd", "a"), (None, text, "a")])
    got = {r.doc_id: r for r in line_dedup.line_table(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4, None)] == [0, 4, 0, 0, 4]
    assert got[2].kept_sha256 == plain.sha("z\n\n") and got[2].n_lines == 5
    assert line_dedup.line_table(odd).count() == odd.count()


# --- near copies -------------------------------------------------------------------------


def test_near_groups_of_odd_rows(odd):
    rows = [(d, t) for d, t, _ in fx.odd_rows() if d is not None and d != 17]
    want = plain.components(list(dict.fromkeys(rows)))
    got = minhash.near_table(odd).collect()
    assert len(got) == len(fx.odd_rows())
    for r in got:
        if r.doc_id in want and r.doc_id != 4:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles > 5} == {1}


def test_near_groups_of_the_sample(spark, sample):
    want = plain.components([r[:2] for r in sample])
    got = queries.QUERIES["op10_near_dedup"](spark, fx.SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_of_near_copies_are_one_component(spark):
    words = fx.prose(7, 200).split()
    rows = []
    for i in range(12):
        words[i * 15] = f"edit{i}"
        rows.append((100 - i, " ".join(words), "a"))
    docs = fx.table(spark, rows)
    want = plain.components([r[:2] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_table(docs).collect()} == want
    left = minhash.drop_near_copies(docs)
    same_columns(left, docs)
    assert {r.doc_id for r in left.collect()} == {c for _, c in want.values()}


@pytest.mark.parametrize("size", [300, 6000])
def test_odd_sketches_pass_links_and_stop_most_others(spark, size):
    words = fx.prose(1, size, 5000).split()
    texts = []
    for i in range(60):
        edited = list(words)
        edited[: i * size // 75 : 7] = [f"e{i}"] * len(edited[: i * size // 75 : 7])
        texts.append(" ".join(edited))
    sets = [minhash.shingle_set(t) for t in texts]
    rows = []
    for i, s in enumerate(sets):
        odd, n, level = minhash.odd_sketch(s)
        rows.append((i, odd.tolist(), n, level))
    side = spark.createDataFrame(rows, "i bigint, odd array<bigint>, n_samples bigint, level int")
    a, b = (side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)) for x in "ab")
    passed = a.join(b, F.col("i_a") < F.col("i_b")).where(minhash.alike(minhash.sketch_of("a"), minhash.sketch_of("b")))
    passed = {(r.i_a, r.i_b) for r in passed.select("i_a", "i_b").collect()}
    for i in range(60):
        for j in range(i + 1, 60):
            same = len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
            assert same < 0.75 or (i, j) in passed
            assert same > (0.7 if size == 300 else 0.64) or (i, j) not in passed


# --- mixing ---------------------------------------------------------------------------------


def check_mix(rows, got):
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(plain.words_of(t))
    targets = plain.mix_targets(sizes)
    assert len(got) == len(rows)
    by_key = Counter((d, len(plain.words_of(t)), sizes[s], round(targets[s], 6)) for d, t, s in rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == by_key
    assert all(r.taken <= 3 * r.size for r in got)
    for s, target in targets.items():
        taken = sum(r.taken for r in got if r.source_size == sizes[s])
        shares = [x for x in targets if sizes[x] == sizes[s]]
        assert abs(taken - sum(targets[x] for x in shares)) <= len(shares) * (2 * mixing.BLOCK_WORDS)


def test_mix_of_odd_rows(odd):
    got = mixing.mix_table(odd).collect()
    check_mix(fx.odd_rows(), got)
    assert whole(mixing.mix_table(odd.repartition(5))) == sorted(map(tuple, got), key=repr)


def test_mix_of_the_sample(spark, sample):
    check_mix(sample, queries.QUERIES["op7_source_mix"](spark, fx.SF).collect())


def test_mixed_rows_hold_the_words_taken(spark, sample):
    docs = fx.table(spark, sample)
    mixed = mixing.mixed(docs)
    same_columns(mixed, docs)
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(plain.words_of(r.text))
    taken = {r.doc_id: r.taken for r in mixing.mix_table(docs).collect()}
    assert {d: n for d, n in taken.items() if n} == dict(words)


def test_permutations_are_permutations():
    import numpy as np

    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, (1, 2, 3)).tolist()) == list(range(n))


# --- tokens -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe.read_ranks(lines)


def test_transducer_equals_the_library(ranks, sample):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    texts = [t or "" for _, t, _ in [*fx.odd_rows(), *sample[:60]]]
    assert all(own.encode(t) == library.encode_ordinary(t) for t in texts)


def test_transducer_with_few_states(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 5)
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = "antidisestablishmentarianism naïveté 中文字符 " * 3
    assert own.encode(text) == library.encode_ordinary(text)


def test_stream_decoding_waits_for_whole_characters(ranks):
    table = {r: b for b, r in ranks.items()}
    text = "é中🙂x"
    ids = [ranks[bytes([b])] for b in text.encode()]
    assert list(bpe.decode_stream([[i] for i in ids], table)) == list(text)
    assert "".join(bpe.decode_stream([ids[:3]], table)) == "é�"


def test_digests_and_round_trip(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.digest_table(odd, path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((d, plain.sha(t or "")) for d, t, _ in fx.odd_rows())
    back = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path)
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, _ in fx.odd_rows())


def test_token_counts_and_cache(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")

    def expected(rows):
        n = [len(model.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
        return sorted(((d, len((t or "").encode()), k, k > 512) for (d, t, _), k in zip(rows, n)), key=repr)

    part = [r for r in fx.odd_rows() if r[0] not in (1, 12)]
    assert whole(token_counts.count_tokens(fx.table(spark, part), path, cache)) == expected(part)
    before = spark.read.parquet(cache).count()
    assert whole(token_counts.count_tokens(odd, path, cache)) == expected(fx.odd_rows())
    assert spark.read.parquet(cache).count() - before == 1  # the long text; the other is a copy
    other = public_tokenizers.path("word_bpe_49k.json")
    words = Tokenizer.from_file(other)
    got = token_counts.count_tokens(odd, other, cache).where("doc_id = 15").first()
    assert got.n_tokens == len(words.encode(fx.odd_rows()[14][1], add_special_tokens=False).ids)


# --- quality --------------------------------------------------------------------------------------


def test_counts_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (99, 0, 0), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_table(odd, labels).collect()
    keys = (*quality.COUNTS, "base_failed")
    want = Counter((d, *(plain.base_counts(t)[k] for k in keys)) for d, t, _ in fx.odd_rows())
    assert Counter((r.doc_id, *(r[k] for k in keys)) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)
    left = quality.good_documents(odd, labels)
    same_columns(left, odd)
    assert left.count() == sum(r.kept for r in got)


def test_rules_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0
    rules = quality.learn(*quality.labelled_sample(docs, labels.where(seen)))
    assert rules
    found, name = quality.statistics(docs.join(labels.where(~seen), "doc_id"))
    verdict = quality.verdict(rules, name)
    judged = found.where(~quality.base_failed(name)).select("quality", (verdict == 0).alias("kept")).collect()
    good = [r.kept for r in judged if r.quality == 1]
    low = [r.kept for r in judged if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(low) / len(low) < 0.3


# --- all ---------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = fx.empty_table(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for result in (
        suffix_dedup.repeat_table(docs),
        fm_index.later_table(docs),
        line_dedup.line_table(docs),
        exact_dedup.copy_groups(docs),
        exact_dedup.drop_copies(docs),
        minhash.near_table(docs),
        minhash.drop_near_copies(docs),
        mixing.mix_table(docs),
        mixing.mixed(docs),
        quality.quality_table(docs, labels),
        bpe.digest_table(docs, path, public_tokenizers.PATTERN),
        token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")),
    ):
        assert result.count() == 0
