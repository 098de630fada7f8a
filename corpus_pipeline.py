"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillscan.llm import bpe, jaccard, mixing, pii, quality
from rillscan.session import keep, reach, table

#: No SQL expresses the fitted stages; each is tested against a brute-force version.
ORACLE_SQL = None


def _free(docs: DataFrame, names: list[str]) -> list[str]:
    return [quality.free_name(docs, n) for n in names]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the rules' votes keep."""
    reach(spark)
    return quality.keep_good(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the document of the least doc_id.

    Of rows with that same doc_id in one component one stays. Rows without a doc_id stay
    if nothing else is in their component; a text without words has no copies.
    """
    return jaccard.keep_first(docs, n=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind.

    A null text stays null and an empty one empty; equal rows are redacted alike, each by itself, and an
    empty table gives no rows. All other columns stay, whatever their names.
    """
    return pii.redact(docs, _free(docs, ["_base_spans", "_spans"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the domains' target weights ask; no document less than once, none over three times.

    Null and empty texts hold no tokens and are used by the rate of an empty text. Equal rows get equal
    rates, and as their doc_id tosses the coin, equal numbers of copies.
    """
    free = _free(docs, ["_tokens", "_good", "_low", "_toxic", "_copy"])
    return mixing.copies(docs, table(spark, sf_dir, "labels"), free, weights=[0.92, 0.05, 0.03], budget=1.2, low=1.0, high=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of what they decode to.

    A null text counts as empty: no ids, the digest of nothing. A row for each row, equal ones included; other
    columns are not read.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", keep_good), ("ngram_jaccard", keep_one_of_near_copies), ("pii", redact), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again. The folders go with the session."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
