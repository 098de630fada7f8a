"""What a search is put together from. Every part takes and returns DataFrames or column expressions."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame


class Matcher(ABC):
    """Reports where patterns occur in a stream."""

    @abstractmethod
    def report(self, stream: DataFrame, patterns: DataFrame) -> DataFrame:
        """(pid, stream_id, pos) for stream(stream_id, pos, token) and patterns(pid, tokens)."""


class Estimator(ABC):
    """How often keys occur."""

    @abstractmethod
    def estimate(self, keys: DataFrame, asked: DataFrame) -> DataFrame:
        """(key, p): asked(key) with its estimated share of keys(key)."""


class Membership(ABC):
    """Which grams each interval holds."""

    @abstractmethod
    def build(self, grams: DataFrame, block: int, least: int) -> DataFrame:
        """(stream_id, block, level, interval, gram) rows that say yes, for grams(stream_id, pos, gram)."""


class PruningPlan(ABC):
    """The level where each pattern's search begins."""

    @abstractmethod
    def levels(self, asked: DataFrame) -> DataFrame:
        """(pid, level), or (pid, k, level) for each gram, for asked(pid, k, gram, m, p)."""


class SearchAlgorithm(ABC):
    """Narrows the places where a match may start."""

    @abstractmethod
    def candidates(self, held: DataFrame, asked: DataFrame, block: int, least: int) -> DataFrame:
        """(pid, stream_id, lo, hi) for membership and asked(pid, k, gram, m, seed, least)."""


class Verifier(ABC):
    """Compares tokens in the places that are left."""

    @abstractmethod
    def verify(self, stream: DataFrame, patterns: DataFrame, ranges: DataFrame) -> DataFrame:
        """(pid, stream_id, pos) of the matches that start in the ranges."""


class CostFunction(ABC):
    """Expected probes of a search that begins at a level."""

    @abstractmethod
    def cost(self, p: Column, keys: Column, width: int, level: int) -> Column:
        """p, keys: arrays of a pattern's gram frequencies and grams."""


class PrunerSolver(ABC):
    """Width in which a pattern's tokens are all present with a given chance."""

    @abstractmethod
    def solve(self, p: Column, target: float) -> Column:
        """p: array of frequencies in (0, 1)."""
