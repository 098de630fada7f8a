"""The registered queries of this subpackage, one for each operator and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, flac, jaccard, mixing, pii, pseudo, quality, suffixes, token_counts, urls


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links of 4-word shingle sets at similarity 0.85."""
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's counts, the base rule, and the verdict of the rules' votes."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's masked pseudo-log-likelihood under a model of all texts."""
    return pseudo.score(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as FLAC, decoded into PCM blocks and digested."""
    return flac.digest(flac.decode(flac.store(table(spark, sf_dir, "documents"))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base spans and those that the trees add."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by the 50k byte-level vocabulary."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, or else by the language models."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the 50k byte-level tokenizer, and whether they exceed 1024."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for every document, so that domains get 85, 10 and 5 % of 0.7 of all tokens."""
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights=[0.85, 0.10, 0.05], budget=0.7)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 400-byte strings that also start elsewhere."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_media_columns": op4_media_columns,
    "op5_pii": op5_pii,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_url_filters": op7_url_filters,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}

#: The two operators that SQL can express whole; the others fit models or write formats and are tested by brute force.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
entries AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON a = doc_id
"""

REPEATS_SQL = """
WITH texts AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, n, k, substr(h, 800 * k + 1, 1600) AS block FROM (SELECT *, unnest(range(0, (n + 399) // 400)) AS k FROM texts WHERE n >= 400)),
starts AS (SELECT doc_id, 400 * k + j AS place, md5(substr(block, 2 * j + 1, 800)) AS content FROM (SELECT *, unnest(range(0, 400)) AS j FROM blocks) WHERE 400 * k + j + 400 <= n),
again AS (SELECT doc_id, place FROM starts QUALIFY count(*) OVER (PARTITION BY content) > 1),
heads AS (SELECT *, (place > lag(place, 1, -1000) OVER (PARTITION BY doc_id ORDER BY place) + 400)::INTEGER AS head FROM again),
numbered AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM heads),
runs AS (SELECT doc_id, min(place) AS lo, max(place) + 400 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM runs),
kept AS (
    SELECT g.doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
    FROM gaps g JOIN texts USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": JACCARD_SQL, "op10_suffix_dedup": REPEATS_SQL}
