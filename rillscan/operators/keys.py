"""Numbers for tokens and grams: dense ids, ranks, and keys of fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bits_for, md5_long


def first_seen(rows: DataFrame, token: str, at: str) -> DataFrame:
    """(token, id): distinct tokens numbered from 1 in the order of their first places.

    The window is over distinct tokens. It is one task, meant for alphabets; ``hashed`` numbers any vocabulary.
    """
    return rows.groupBy(F.col(token).alias("token")).agg(F.min(at).alias("first_at")).select("token", F.row_number().over(Window.orderBy("first_at", "token")).cast("long").alias("id"))


def dense_ranks(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows with ``r``: the dense rank of the value in its group.

    Distinct values of a group are ranked once and joined, so a group with many rows of few values is no large window.
    """
    ranks = rows.select(by, value).distinct().withColumn("r", F.dense_rank().over(Window.partitionBy(by).orderBy(value)).cast("long"))
    return rows.join(ranks, [by, value])


def product(alphabet: DataFrame) -> DataFrame:
    """(t0, t1, id): all pairs of an alphabet(token), numbered by row and column. The alphabet is collected into one array."""
    letters = F.array_sort(F.collect_set("token"))
    rows = alphabet.agg(letters.alias("a")).select("a", F.posexplode("a").alias("i", "t0")).select("a", "i", "t0", F.posexplode("a").alias("j", "t1"))
    return rows.select("t0", "t1", (F.col("i") * F.size("a") + F.col("j")).cast("long").alias("id"))


def pack(parts: list[Column], widths: list[int]) -> Column:
    """One number from whole parts, the first in the highest bits; null where a part does not fit its width."""
    if sum(widths) > 63:
        raise ValueError("more than 63 bits")
    fits, out = F.lit(True), F.lit(0).cast("long")
    for part, width in zip(parts, widths):
        fits = fits & part.between(0, (1 << width) - 1)
        out = F.shiftleft(out, width).bitwiseOR(part.cast("long"))
    return F.when(fits, out)


def unpack(packed: Column, widths: list[int]) -> list[Column]:
    """The parts of a packed number."""
    out, below = [], sum(widths)
    for width in widths:
        below -= width
        out.append(F.shiftright(packed, below).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def interval_bits(width: int, level: int) -> int:
    """Bits that number the intervals of a level; the level must be one of the block's."""
    if not 0 <= level < width.bit_length():
        raise ValueError(f"no level {level} in a block of {width}")
    return level


def hashed(token: Column, bits: int) -> Column:
    """A number of so many bits, up to 60, for any token."""
    if not 1 <= bits <= 60:
        raise ValueError("1 to 60 bits")
    return F.shiftright(md5_long(token), 60 - bits)


def sized(grams: DataFrame, epsilon: float) -> DataFrame:
    """(gram, key, bits): distinct grams by hashes just wide enough that they collide with a chance of epsilon at most; 60 bits if more were needed."""
    distinct = grams.select("gram").distinct()
    n = distinct.agg(F.count("*").cast("double").alias("n"))
    bits = F.least(bits_for(F.greatest("n", F.lit(2.0)), F.lit(epsilon)), F.lit(60))
    return distinct.crossJoin(F.broadcast(n.select(bits.alias("bits")))).withColumn("whole", md5_long(F.col("gram"))).select("gram", F.expr("shiftright(whole, int(60 - bits))").alias("key"), "bits")


def universal(token: Column, row: int, buckets: int, seed: int = 0) -> Column:
    """The row-th hash function of a family, into buckets: ((a x + b) mod p) mod buckets with a and b from the seed and p = 2^31 - 1."""
    prime = (1 << 31) - 1
    number = lambda name: F.pmod(md5_long(F.lit(f"{name}:{seed}:{row}")), F.lit(prime - 1)) + 1
    return F.pmod(F.pmod(number("a") * F.pmod(md5_long(token), F.lit(prime)) + number("b"), F.lit(prime)), F.lit(buckets))
