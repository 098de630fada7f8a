"""A search put together from parts, and the four usual combinations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy, match, sketches
from ..session import cut
from . import costs, levels
from .interfaces import Estimator, Matcher, Membership, PruningPlan, SearchAlgorithm, Verifier


class ExactCounts(Estimator):
    """Shares by counting; with a declared total instead of the counted one if given."""

    def __init__(self, total: int | None = None):
        self.total = total

    def estimate(self, keys: DataFrame, asked: DataFrame) -> DataFrame:
        counted = keys.groupBy("key").agg(F.count("*").alias("n"))
        total = F.lit(self.total) if self.total else F.col("total")
        both = counted.crossJoin(keys.agg(F.count("*").alias("total")))
        return asked.join(both.select("key", (F.col("n") / total).alias("p")), "key", "left").select("key", F.coalesce("p", F.lit(0.0)).alias("p"))


class Sketched(Estimator):
    """Shares by a count sketch; none is below 0."""

    def __init__(self, width: int = 2048, depth: int = 8):
        self.width, self.depth = width, depth

    @classmethod
    def within(cls, epsilon: float, delta: float) -> Sketched:
        """The sketch whose estimates err by epsilon times the counts' norm but for a chance of delta."""
        return cls(*sketches.sketch_size(epsilon, delta))

    def estimate(self, keys: DataFrame, asked: DataFrame) -> DataFrame:
        tokens = keys.withColumnRenamed("key", "token")
        found = sketches.sketch_estimates(sketches.count_sketch(tokens, self.width, self.depth), asked.withColumnRenamed("key", "token"), self.width, self.depth)
        return found.crossJoin(tokens.agg(F.count("*").alias("total"))).select(F.col("token").alias("key"), (F.greatest("estimate", F.lit(0)) / F.col("total")).alias("p"))


class ExactMembership(Membership):
    """The distinct grams of every interval."""

    def build(self, grams: DataFrame, block: int, least: int) -> DataFrame:
        return hierarchy.members(grams, block, least)


class Halving(SearchAlgorithm):
    """Probes a pattern's grams in order and halves the intervals that hold all of them."""

    def candidates(self, held: DataFrame, asked: DataFrame, block: int, least: int) -> DataFrame:
        return hierarchy.candidates(held, asked, block, least)[0]


class Compare(Verifier):
    """Compares token by token."""

    def verify(self, stream: DataFrame, patterns: DataFrame, ranges: DataFrame) -> DataFrame:
        return hierarchy.verify(stream, patterns, ranges)


@dataclass(frozen=True)
class Search(Matcher):
    """A search of token streams; ``but`` gives a copy with other parts."""

    block: int
    n: int
    plan: PruningPlan
    stride: bool = False
    estimator: Estimator = ExactCounts()
    membership: Membership = ExactMembership()
    algorithm: SearchAlgorithm = Halving()
    verifier: Verifier = Compare()

    def but(self, **parts) -> Search:
        return replace(self, **parts)

    def asked(self, stream: DataFrame, patterns: DataFrame) -> DataFrame:
        """(pid, k, gram, m, p, seed, least) of the patterns' grams."""
        grams = match.ngrams(stream, self.n)
        asked = match.pattern_grams(patterns, self.n)
        shares = self.estimator.estimate(grams.select(F.col("gram").alias("key")), asked.select(F.col("gram").alias("key")).distinct())
        known = asked.join(shares.withColumnRenamed("key", "gram"), "gram")
        rated = match.stride(known, self.n) if self.stride else known
        return cut(hierarchy.with_levels(known, self.plan.levels(rated)))

    def report(self, stream: DataFrame, patterns: DataFrame) -> DataFrame:
        """(pid, stream_id, pos); patterns of fewer than n tokens are left to division."""
        long = patterns.where(F.size("tokens") >= self.n)
        asked = self.asked(stream, long)
        grams = match.ngrams(stream, self.n).join(asked.select("gram").distinct(), "gram", "left_semi")
        held = cut(self.membership.build(grams, self.block, self.n))
        found = self.verifier.verify(stream, long, self.algorithm.candidates(held, asked, self.block, self.n))
        short = patterns.where((F.size("tokens") < self.n) & (F.size("tokens") > 0))
        return found.unionByName(match.find_tokens(stream, short, 1)) if short.take(1) else found


def preset(name: str, block: int, n: int, confidence: float = 0.99, beta: float = 0.15) -> Search:
    """bs: from whole blocks. cp: by the rarest gram. cgbs: by each gram. cf: by least cost."""
    plans = {
        "bs": lambda: levels.Root(),
        "cp": lambda: levels.Confidence(block, n, confidence, beta),
        "cgbs": lambda: levels.EachGram(block, n, confidence, beta),
        "cf": lambda: levels.LeastCost(block, n, costs.Independent(beta)),
    }
    return Search(block, n, plans[name]())
