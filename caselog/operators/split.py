"""Repeatable splits, folds and samples, ordered by a hash of the case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.functions.hashing import hash_pick, hex_slice, shuffle_key, unit_hash
from caselog.operators.ranks import row_number_by_slice


def _ranked(df: DataFrame, by: list[str], key: str, seed: int, out: str) -> DataFrame:
    keyed = df.withColumn("_key", shuffle_key(key, seed))
    return row_number_by_slice(keyed, by, [F.col("_key"), F.col(key)], hex_slice("_key"), out).drop("_key")


def split_exact(cases: DataFrame, case: str, fraction: float, seed: int = 22, label: str | None = None) -> DataFrame:
    """Mark floor(fraction * n) cases as training, inside each label if one is given.

    ``cases`` holds each case once. The mark is column ``is_train``.
    """
    by = [label] if label else []
    ranked = _ranked(cases, by, case, seed, "_rank")
    sizes = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else cases.agg(F.count(F.lit(1)).alias("_n"))
    if by:  # one row per class; no hint, Spark checks the size itself
        right = sizes.withColumnRenamed(label, "_label")
        joined = ranked.join(right, ranked[label].eqNullSafe(right["_label"])).drop("_label")
    else:
        joined = ranked.crossJoin(F.broadcast(sizes))  # one row
    return joined.withColumn("is_train", F.col("_rank") <= F.floor(F.lit(fraction) * F.col("_n"))).drop("_rank", "_n")


def split_threshold(df: DataFrame, key: str, fraction: float, seed: int = 22) -> DataFrame:
    """Mark rows whose key hashes below the fraction: no shuffle, size right on average.

    With the case as key, all events of a case fall on one side.
    """
    return df.withColumn("is_train", unit_hash(key, seed) < F.lit(fraction))


def stratified_folds(cases: DataFrame, case: str, label: str, k: int = 5, seed: int = 22) -> DataFrame:
    """Fold 0..k-1 per case; fold sizes differ by at most one inside each class."""
    ranked = _ranked(cases, [label], case, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def row_folds(df: DataFrame, key: str, seed: int = 22) -> DataFrame:
    """A fold of its own for every row (leave-one-out table)."""
    return _ranked(df, [], key, seed, "_rank").withColumn("fold", F.col("_rank") - 1).drop("_rank")


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 22) -> DataFrame:
    """n distinct keys at random (all of them when there are fewer)."""
    keys = df.select(key).distinct()
    return keys.orderBy(shuffle_key(key, seed), key).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows at random; ``key`` is unique."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def balance_down(df: DataFrame, key: str, label: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest has, at most ``cap`` if given."""
    ranked = _ranked(df, [label], key, seed, "_rank")
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_least"))
    least = F.col("_least") if cap is None else F.least(F.col("_least"), F.lit(cap))
    return ranked.crossJoin(F.broadcast(smallest)).filter(F.col("_rank") <= least).drop("_rank", "_least")


def oversample(df: DataFrame, key: str, label: str, minority, seed: int = 22) -> DataFrame:
    """Add repeats of minority rows, drawn with replacement, until the class sizes meet.

    Draw i picks the minority row number hash(i) mod n. Draws are a
    distributed range and meet the rows by an equi join on that number.
    """
    spark = df.sparkSession
    is_minor = F.col(label) == F.lit(minority)
    sizes = df.agg(F.count_if(is_minor).alias("minor"), F.count_if(~is_minor).alias("major")).first()
    if sizes["minor"] == 0 or sizes["major"] <= sizes["minor"]:
        return df
    minor = _ranked(df.filter(is_minor), [], key, seed, "_rank")
    draws = spark.range(sizes["major"] - sizes["minor"]).select(
        (hash_pick("id", seed, sizes["minor"]) + 1).alias("_rank")
    ).groupBy("_rank").agg(F.count(F.lit(1)).alias("_times"))
    extra = minor.join(draws, "_rank").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return df.unionByName(extra.select(*df.columns))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in random order (a range-partitioned sort on the hash)."""
    return df.orderBy(shuffle_key(key, seed), key)
