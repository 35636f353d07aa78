"""The ten operators over the driver's tables, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clientpulse.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.suffix_dedup import repeat_table

    return repeat_table(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.line_dedup import line_table

    return line_table(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
wordy AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT a.doc_id, a.n, [a.pos, b.pos, c.pos] AS covers,
         row_number() OVER (PARTITION BY a.line, b.line, c.line ORDER BY a.doc_id, a.n) AS turn
  FROM wordy a JOIN wordy b ON b.doc_id = a.doc_id AND b.n = a.n + 1
               JOIN wordy c ON c.doc_id = a.doc_id AND c.n = a.n + 2),
gone AS (SELECT DISTINCT doc_id, unnest(covers) AS pos FROM windows WHERE turn > 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(w.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM wordy GROUP BY 1) w USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
LEFT JOIN kept k USING (doc_id)
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.html_text import page_table

    return page_table(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.exact_dedup import copy_groups

    return copy_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clientpulse.llm.bpe import digest_table

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digest_table(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clientpulse.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.mixing import mix_table

    return mix_table(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.fm_index import later_table

    return later_table(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.quality import quality_table

    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.minhash import near_table

    return near_table(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.whitening import whitened_rows

    return whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
wordy AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM wordy, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM wordy GROUP BY lang),
held AS (
  SELECT lang, array_to_string(p[i : i + k - 1], ' ') AS phrase, max(n) AS longer
  FROM (SELECT lang, n, k AS size, string_split(phrase, ' ') AS p FROM f WHERE k > 2) longer_phrases,
       (VALUES (2), (3), (4)) AS sizes(k), (VALUES (1), (2), (3), (4)) AS starts(i)
  WHERE k < size AND i + k - 1 <= size GROUP BY ALL),
alive AS (
  SELECT f.lang, f.phrase, f.k, f.n AS a, string_split(f.phrase, ' ') AS p
  FROM f LEFT JOIN held USING (lang, phrase) WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * f.n)),
cuts AS (
  SELECT alive.lang, alive.phrase, a, l.n AS l, r.n AS r, t.n, c,
         (1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n) AS score
  FROM alive JOIN (VALUES (1), (2), (3), (4)) AS cut(c) ON c < alive.k
  JOIN f l ON l.lang = alive.lang AND l.phrase = array_to_string(p[1 : c], ' ')
  JOIN f r ON r.lang = alive.lang AND r.phrase = array_to_string(p[c + 1 : alive.k], ' ')
  JOIN totals t ON t.lang = alive.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS turn FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM low WHERE turn = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientpulse.llm.ngram_join import linked_documents

    return linked_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_line_dedup, op3_html_text, op4_exact_dedup, op5_byte_bpe, op6_token_counts, op7_source_mix, op8_substring_dedup, op9_quality_rules, op10_near_dedup, op11_embedding_whitening, op12_collocations, op13_ngram_join)
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op12_collocations": OP12_SQL}
