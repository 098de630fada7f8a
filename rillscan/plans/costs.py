"""Expected probes of a descent, by the level where it begins.

A node of a level costs the probes until its first no. If all its grams are said to be
there, its halves are visited as long as one has room for the pattern. Levels are few,
so the sum over them is written out as one expression for each first level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as pr
from .interfaces import CostFunction, PrunerSolver

#: Weights of depth, feasibility and cost in how many halves are worth visiting.
FANOUT_WEIGHTS = (0.4, 0.4, 0.2)


def fanout(level: int, first: int, last: Column, present: Column, probes: Column, probes_below: Column) -> Column:
    """Halves that a selective search visits, between 1 and 2."""
    depth = F.when(last > first, (level - first) / (last - first)).otherwise(0.0)
    cheap = F.when(probes_below <= 0, 0.0).when(probes <= 0, 1.0).otherwise(pr.clamped(probes / probes_below))
    w = FANOUT_WEIGHTS
    return 1 + pr.clamped(w[0] * depth + w[1] * pr.clamped(present) + w[2] * cheap)


class Descent(CostFunction):
    """The sum over levels; what a node costs is for subclasses to say."""

    def __init__(self, selective: bool = False):
        self.selective = selective

    def root(self, p: Column, keys: Column, width: int, level: int) -> tuple[Column, Column]:
        """Probes of a node of the first level, and the chance that all is there."""
        raise NotImplementedError

    def below(self, p: Column, keys: Column, width: int, level: int) -> tuple[Column, Column]:
        """The same for a node whose parent said yes to all."""
        raise NotImplementedError

    def cost(self, p: Column, keys: Column, width: int, level: int) -> Column:
        length = F.size(keys).cast("long")
        last = pr.deepest_level(width, length)
        probes, present = self.root(p, keys, width, level)
        nodes, total = F.lit(float(1 << level)), probes * float(1 << level)
        for at in range(level, width.bit_length() - 1):
            visited = (F.lit(at) < last) & pr.child_can_host(width, F.lit(at), length)
            under, there = self.below(p, keys, width, at + 1)
            halves = fanout(at, level, last, present, probes, under) if self.selective else F.lit(2.0)
            nodes = F.when(visited, nodes * halves * present).otherwise(0.0)
            total, probes, present = total + F.when(visited, nodes * under).otherwise(0.0), under, there
        return total


class Independent(Descent):
    """Grams occur independently of each other; filters err with rate beta."""

    def __init__(self, beta: float = 0.0, selective: bool = False):
        super().__init__(selective)
        self.beta = beta

    def root(self, p, keys, width, level):
        q = pr.said_at(p, width, F.lit(level), self.beta)
        return pr.expected_probes(q, keys), pr.all_yes(q, keys)

    def below(self, p, keys, width, level):
        q = pr.said_at_child(p, width, F.lit(level), self.beta, self.beta)
        return pr.expected_probes(q, keys), pr.all_yes(q, keys)


class InclusionExclusion(Descent):
    """Grams compete for places: chances by inclusion and exclusion, up to subsets of ``order`` grams. Exponential in distinct grams."""

    def __init__(self, order: int | None = None, selective: bool = False):
        super().__init__(selective)
        self.order = order

    def _both(self, p, keys, places):
        found = pr.probes_by_subsets(p, keys, places, 0.0, self.order)
        return found["probes"], found["present"]

    def root(self, p, keys, width, level):
        return self._both(p, keys, pr.span(width, F.lit(level)))

    def below(self, p, keys, width, level):
        places = pr.span(width, F.lit(level))
        # the frequency under which a gram would be there with the chance that it has after the parent's yes
        after = F.transform(pr.said_at_child(p, width, F.lit(level), 0.0, 0.0), lambda q: pr.clamped(1 - F.pow(1 - q, 1 / F.greatest(places, F.lit(1)))))
        return self._both(after, keys, places)


class Fixed(CostFunction):
    """Every level costs the same; the first is taken."""

    def cost(self, p, keys, width, level):
        return F.lit(0.0)


class Bisection(PrunerSolver):
    """The width by bisection."""

    def solve(self, p, target):
        return pr.solve_width(p, target)


def cheapest(asked: DataFrame, cost: CostFunction, width: int, least: int) -> DataFrame:
    """(pid, level, cost): the level of the least expected probes; of equals the first.

    asked(pid, k, gram, m, p); the deepest level leaves room for the pattern's grams.
    """
    order = F.array_sort(F.collect_list(F.struct("k", "gram", "p")))
    arrays = asked.groupBy("pid").agg(order.alias("s")).select("pid", F.transform("s", lambda s: s["gram"]).alias("keys"), F.transform("s", lambda s: s["p"]).alias("p"))
    depth = (width // least).bit_length()
    last = F.greatest(F.lit(depth - 1) - F.ceil(F.log2(F.size("keys").cast("double"))), F.lit(0))
    every = [F.when(F.lit(level) <= last, F.struct(cost.cost(F.col("p"), F.col("keys"), width, level).alias("cost"), F.lit(level).cast("long").alias("level"))) for level in range(depth)]
    best = F.array_min(F.filter(F.array(*every), lambda s: s.isNotNull()))
    return arrays.select("pid", best.alias("best")).select("pid", "best.level", F.col("best.cost").alias("cost"))
