"""Hashes that other SQL engines can repeat: 60 bits of MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_long(text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 as a number, never negative."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def bits_for(n: Column, epsilon: Column) -> Column:
    """Bits of a hash so that n keys collide with a chance of epsilon at most."""
    return F.greatest(F.lit(1), F.ceil(F.log2(n * (n - 1) / (-2 * F.log1p(-epsilon))))).cast("long")


def collision_chance(n: Column, bits: Column) -> Column:
    """Chance that n keys collide in a hash of so many bits."""
    return -F.expm1(-(n * (n - 1)) / F.pow(F.lit(2.0), bits + 1))
