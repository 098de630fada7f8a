"""Synthetic streams, the same for the same parameters however the work is split."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..session import reach


def uniform(spark: SparkSession, n: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """(pos, token): characters of the codes low to high, all as likely."""
    return spark.range(n).select(F.col("id").alias("pos"), F.chr(low + F.floor(unit(F.concat_ws(":", F.lit(str(seed)), "id")) * (high - low + 1))).alias("token"))


def zipf(spark: SparkSession, n: int, sigma: int, exponent: float = 1.0, base: int = 40, seed: int = 0) -> DataFrame:
    """(pos, token): rank k with a weight of 1 / k ** exponent, drawn by the inverse distribution function."""
    weights = [1 / k**exponent for k in range(1, sigma + 1)]
    reach = list(itertools.accumulate(w / sum(weights) for w in weights))
    u = unit(F.concat_ws(":", F.lit(str(seed)), "id"))
    rank = sum((F.when(u >= r, 1).otherwise(0) for r in reach[:-1]), F.lit(0))
    return spark.range(n).select(F.col("id").alias("pos"), F.chr(base + rank).alias("token"))


def blocks(spark: SparkSession, n: int, block: int, alphabet: str) -> DataFrame:
    """(pos, token): runs of one character, letter after letter."""
    letters = F.array(*map(F.lit, alphabet))
    return spark.range(n).select(F.col("id").alias("pos"), F.get(letters, (F.floor(F.col("id") / block) % len(alphabet)).cast("int")).alias("token"))


def de_bruijn_cycle(alphabet: str, order: int) -> str:
    """A shortest cycle that holds every word of the order once: Lyndon words in lexicographic order."""
    k, out, word = len(alphabet), [], [-1]
    while word:
        word[-1] += 1
        if order % len(word) == 0:
            out += word
        m = len(word)
        while len(word) < order:
            word.append(word[-m])
        while word and word[-1] == k - 1:
            word.pop()
    return "".join(alphabet[i] for i in out)


def de_bruijn(spark: SparkSession, n: int, alphabet: str, order: int) -> DataFrame:
    """(pos, token): the cycle over and over, up to n characters. The cycle, alphabet ** order long, is a literal."""
    cycle = de_bruijn_cycle(alphabet, order)
    return spark.range(n).select(F.col("id").alias("pos"), F.substring(F.lit(cycle), (F.col("id") % len(cycle) + 1).cast("int"), F.lit(1)).alias("token"))


def transition_matrix(sigma: int, order: int = 1, seed: int = 0) -> np.ndarray:
    """(sigma ** order, sigma): chances of the next symbol after each context, drawn from the seed."""
    weights = np.random.default_rng([seed, sigma, order]).random((sigma**order, sigma)) ** 3
    return weights / weights.sum(1, keepdims=True)


def markov(spark: SparkSession, streams: int, n: int, matrix: np.ndarray, base: int = 70, seed: int = 0) -> DataFrame:
    """(stream_id, pos, token): a chain of n symbols for each stream by a transition matrix of any order.

    A stream's draws follow from the seed and its number alone. The first context is 0s.
    """
    reach(spark)
    rows, sigma = matrix.shape
    upto = np.cumsum(matrix, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("id").to_pylist():
                draws, context, out = np.random.default_rng([seed, stream]).random(n), 0, np.empty(n, np.int64)
                for i, u in enumerate(draws):
                    out[i] = symbol = min(int(np.searchsorted(upto[context], u, side="right")), sigma - 1)
                    context = (context * sigma + symbol) % rows
                yield pa.record_batch([pa.array(np.full(n, stream)), pa.array(np.arange(n)), pa.array([chr(base + x) for x in out.tolist()])], ["stream_id", "pos", "token"])

    return spark.range(streams).mapInArrow(run, "stream_id long, pos long, token string")
