"""Formulas of the pruning model, as column expressions.

p: how often a token occurs at a place; beta: false-positive rate of a filter; a block
has ``width`` tokens and is halved on each level. Arrays are in probe order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(width: int, level: Column) -> Column:
    """Tokens of an interval of the level."""
    return F.floor(F.lit(width) / F.pow(F.lit(2.0), level)).cast("long")


def hit(width: int, level: Column, p: Column, besides: int = 0) -> Column:
    """Chance that an interval of the level holds the token, besides so many places that are taken."""
    return 1 - F.pow(1 - p, (span(width, level) - besides).cast("double"))


def said(h: Column, beta) -> Column:
    """Chance that a filter says yes."""
    return h + beta * (1 - h)


def said_below(h_child: Column, q_parent: Column, beta) -> Column:
    """Chance that the child's filter says yes after the parent's did."""
    return beta + (1 - beta) * h_child / q_parent


def clamped(x: Column) -> Column:
    """Into [0, 1]."""
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def said_at(p: Column, width: int, level: Column, beta) -> Column:
    """Of each token of an array the chance of a yes at the level, whatever was said above; as many as fit the interval."""
    return F.transform(F.slice(p, 1, F.least(F.size(p).cast("long"), span(width, level)).cast("int")), lambda x: clamped(said(hit(width, level, x), beta)))


def said_at_child(p: Column, width: int, level: Column, beta_parent, beta) -> Column:
    """The same after the parent's filter, one level up, said yes."""

    def one(x: Column) -> Column:
        above, here = hit(width, level - 1, x), hit(width, level, x)
        yes = said(above, beta_parent)
        return F.when(yes > 0, clamped((here + beta * (above - here) + beta * beta_parent * (1 - above)) / yes)).otherwise(1.0)

    return F.transform(F.slice(p, 1, F.least(F.size(p).cast("long"), span(width, level)).cast("int")), one)


def child_can_host(width: int, level: Column, length: Column) -> Column:
    """Whether a half of an interval of the level has room for the pattern."""
    return span(width, level + 1) >= length


def deepest_level(width: int, length: Column) -> Column:
    """The last level whose intervals have room for the pattern."""
    return F.greatest(F.floor(F.log2((F.floor(F.lit(width) / F.greatest(length, F.lit(1)))).cast("double") + 1e-9)), F.lit(0)).cast("long")


def pruning_level(width: int, confidence: float, p: Column) -> Column:
    """First level worth probing for a token of frequency p, by natural logarithms."""
    b = F.ln(F.lit(1 - confidence)) / F.ln(1 - p)
    depth = width.bit_length() - 1
    level = F.least(F.ceil(F.ln(width / b)), F.lit(depth - 1))
    return F.greatest(F.when(level > 0, level + 1).otherwise(level), F.lit(0)).cast("long")


def pruning_level_filtered(width: int, confidence: float, p: Column, beta: float) -> Column:
    """The same where filters err with rate beta."""
    depth = width.bit_length() - 1
    if confidence <= beta:
        return F.lit(depth - 1).cast("long")
    # a token that never occurs has no width in which it would be likely
    b = F.try_divide(F.log1p(F.lit(-confidence)) - F.log1p(F.lit(-beta)), F.log1p(-p))
    return F.when((b > 0) & ~F.isnan(b), F.least(F.greatest(F.ceil(F.ln(width / b)) + 1, F.lit(0)), F.lit(depth))).otherwise(0).cast("long")


def firsts(keys: Column) -> Column:
    """Places of an array's elements where each occurs first, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: F.array_position(keys, F.get(keys, i)) == i + 1)


def expected_probes(q: Column, keys: Column | None = None) -> Column:
    """Probes until the first no: 1 plus the products of all but the last prefix; q an array.

    keys: a token that occurred before does not lower the chance of going on, but is probed again.
    """
    own = q if keys is None else F.transform(q, lambda x, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, x).otherwise(1.0))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("product"))
    return F.aggregate(own, start, lambda a, x: F.struct((a["sum"] + a["product"]).alias("sum"), (a["product"] * x).alias("product")), lambda a: a["sum"])


def all_yes(q: Column, keys: Column | None = None) -> Column:
    """Product of an array; with keys, over the first place of each."""
    own = q if keys is None else F.transform(q, lambda x, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, x).otherwise(1.0))
    return clamped(F.aggregate(own, F.lit(1.0), lambda a, x: a * x))


def all_present(p: Column, places: Column, beta=0.0, order: int | None = None) -> Column:
    """Chance that each of the distinct tokens is said to be in so many places, by inclusion and exclusion over subsets.

    Exponential in the tokens; order stops at subsets of so many.
    """
    least = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("weight"), F.lit(0).alias("size"))
    grow = lambda sets, x: F.concat(sets, F.transform(sets, lambda s: F.struct((s["sum"] + x).alias("sum"), (s["weight"] * (beta - 1)).alias("weight"), (s["size"] + 1).alias("size"))))
    sets = F.aggregate(p, F.array(least), grow)
    some = sets if order is None else F.filter(sets, lambda s: s["size"] <= order)
    return clamped(F.aggregate(some, F.lit(0.0), lambda a, s: a + s["weight"] * F.pow(clamped(1 - s["sum"]), places.cast("double"))))


def probes_by_subsets(p: Column, keys: Column, places: Column, beta=0.0, order: int | None = None) -> Column:
    """struct(probes, present): expected probes of a node and the chance that all its grams are said to be there."""
    fit = F.least(F.size(keys).cast("long"), places).cast("int")
    own = F.slice(keys, 1, fit)
    at = firsts(own)
    distinct = F.transform(at, lambda i: clamped(F.get(p, i)))
    chances = F.transform(F.sequence(F.lit(1), F.size(at)), lambda m: all_present(F.slice(distinct, 1, m), places, beta, order))
    gaps = F.transform(at, lambda i, m: F.coalesce(F.get(at, m + 1), fit - 1) - i)
    probes = F.aggregate(F.zip_with(gaps, chances, lambda g, c: g * c), F.lit(1.0), lambda a, x: a + x)
    return F.when(fit <= 0, F.struct(F.lit(0.0).alias("probes"), F.lit(1.0).alias("present"))).otherwise(F.struct(probes.alias("probes"), F.element_at(chances, -1).alias("present")))


def solve_width(p: Column, target: float, rounds: int = 80) -> Column:
    """b with product of (1 - (1 - p_i) ** b) = target, by bisection; p an array of doubles in (0, 1)."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1e6).alias("high"))

    def halve(a, _):
        middle = (a["low"] + a["high"]) / 2
        value = F.aggregate(p, F.lit(1.0), lambda x, y: x * (1 - F.pow(1 - y, middle)))
        return F.when(value < target, F.struct(middle.alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), middle.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda a: (a["low"] + a["high"]) / 2)


def dkw_band(n: Column, delta: Column) -> Column:
    """Half width of the band around an empirical distribution of n draws."""
    return F.sqrt(F.ln(2 / delta) / (2 * n))


def draws_needed(epsilon: Column, delta: Column) -> Column:
    return F.ceil(F.ln(2 / delta) / (2 * epsilon * epsilon)).cast("long")


def occupied(buckets: Column, keys: Column) -> Column:
    """Expected buckets with a key."""
    return buckets * (1 - F.pow(1 - 1 / buckets, keys))


def occupied_variance(buckets: Column, keys: Column) -> Column:
    """Variance of the number of buckets with a key."""
    empty, two = F.pow(1 - 1 / buckets, keys), F.pow(1 - 2 / buckets, keys)
    q = 1 - empty
    return F.greatest(buckets * q * (1 - q) + buckets * (buckets - 1) * (1 - 2 * empty + two - q * q), F.lit(0.0))


def occupied_at_least(buckets: Column, keys: Column, delta: Column) -> Column:
    """Buckets with a key, but for a chance of delta, by Chebyshev's bound."""
    return F.floor(F.greatest(occupied(buckets, keys) - F.sqrt(occupied_variance(buckets, keys) / F.greatest(delta, F.lit(1e-12))), F.lit(0.0))).cast("long")


def buckets_needed(keys: Column, needed: Column, delta: Column, most: int = 24) -> Column:
    """The least number of buckets, up to 2 ** most, of which ``needed`` have a key but for a chance of delta; null if none. By bisection."""
    enough = lambda b: occupied_at_least(b.cast("double"), keys, delta) >= needed
    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(1 << most).cast("long").alias("high"))

    def halve(a, _):
        middle = F.floor((a["low"] + a["high"]) / 2).cast("long")
        return F.when(a["high"] - a["low"] <= 1, a).when(enough(middle), F.struct(a["low"].alias("low"), middle.alias("high"))).otherwise(F.struct(middle.alias("low"), a["high"].alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(most + 1)), start, halve, lambda a: a["high"])
    return F.when((keys >= needed) & enough(F.lit(float(1 << most))), found)


def value_error(found: Column, truth: Column) -> Column:
    """Error of an estimate relative to the truth, or to 1 if that is more."""
    return F.abs(found - truth) / F.greatest(truth, F.lit(1.0))


def alphabet_size(base: int, n: int, width: int) -> int:
    """Distinct grams of n symbols that a block can hold."""
    return min(base**n, width)
