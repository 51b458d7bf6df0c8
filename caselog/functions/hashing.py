"""Repeatable pseudo-random order from MD5 of a key and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselog.functions.scalars import col


def shuffle_key(key, seed: int | str) -> Column:
    """32 hex digits that order the keys at random, the same on every run."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"_{seed}")))


def unit_hash(key, seed: int | str) -> Column:
    """The first 32 bits of the shuffle key as a number in [0, 1)."""
    return F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_pick(key, seed: int | str, n, digits: int = 15) -> Column:
    """A whole number in [0, n) taken from the first hex digits of the shuffle key; 15 digits are 60 bits."""
    number = F.conv(F.substring(shuffle_key(key, seed), 1, digits), 16, 10).cast("bigint")
    return number % (n if isinstance(n, Column) else F.lit(n))


def hex_slice(hex_key, digits: int = 3) -> Column:
    """Leading hex digits: an even split that keeps the order of the key."""
    return F.substring(col(hex_key), 1, digits)
