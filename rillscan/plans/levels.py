"""Plans: the level where a pattern's search begins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability as pr
from .costs import cheapest
from .interfaces import CostFunction, PruningPlan


class Root(PruningPlan):
    """Every search begins with whole blocks."""

    def levels(self, asked: DataFrame) -> DataFrame:
        return asked.select("pid").distinct().withColumn("level", F.lit(0).cast("long"))


class Fixed(PruningPlan):
    """Every search begins at one level."""

    def __init__(self, level: int):
        self.level = level

    def levels(self, asked: DataFrame) -> DataFrame:
        return asked.select("pid").distinct().withColumn("level", F.lit(self.level).cast("long"))


class Confidence(PruningPlan):
    """Begins where an interval is expected to hold the rarest gram with the confidence asked for."""

    def __init__(self, width: int, least: int, confidence: float = 0.99, beta: float = 0.0, root: int = 0):
        self.width, self.confidence, self.beta, self.root, self.last = width, confidence, beta, root, (width // least).bit_length() - 1

    def level(self, p):
        wanted = pr.pruning_level_filtered(self.width, self.confidence, F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 1e-15)), self.beta)
        return F.least(F.greatest(wanted, F.lit(self.root)), F.lit(self.last)).cast("long")

    def levels(self, asked: DataFrame) -> DataFrame:
        return asked.groupBy("pid").agg(F.min("p").alias("p")).select("pid", self.level(F.col("p")).alias("level"))


class EachGram(Confidence):
    """The same for each gram: above its level a gram is not probed."""

    def levels(self, asked: DataFrame) -> DataFrame:
        return asked.select("pid", "k", self.level(F.col("p")).alias("level"))


class LeastCost(PruningPlan):
    """Begins where a cost function expects the fewest probes."""

    def __init__(self, width: int, least: int, cost: CostFunction):
        self.width, self.least, self.cost = width, least, cost

    def levels(self, asked: DataFrame) -> DataFrame:
        return cheapest(asked, self.cost, self.width, self.least).select("pid", "level")
