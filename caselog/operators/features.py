"""Feature selection, alignment and weights on the long cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from caselog.functions.scalars import sparse_vector

MIN_SHARE = 0.01  # fixed value: features non-zero in fewer cases are dropped


def small_table(df: DataFrame, most: int) -> list[Row]:
    """Rows of a table that must be small; an error when it is not, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use the long form instead")
    return rows


def nonzero_shares(cells: DataFrame, n_cases: DataFrame) -> DataFrame:
    """(feature, n, share): cases with a non-zero cell, over all cases (one-row table n_cases)."""
    counts = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(n_cases)).select("feature", "n", (F.col("n") / F.col("n_cases")).alias("share"))


def kept(shares: DataFrame, least: float = MIN_SHARE, always: Column | None = None) -> DataFrame:
    """Features whose share reaches ``least``, and those that are always kept."""
    good = F.col("share") >= least
    return shares.filter(good if always is None else good | always)


def align(cells: DataFrame, feature_table: DataFrame) -> DataFrame:
    """Cells of known features only; a feature without a cell is 0 by absence."""
    return cells.join(feature_table.select("feature"), "feature", "left_semi")


def column_differences(train: DataFrame, test: DataFrame) -> DataFrame:
    """Features the test data lacks (missing) or has on top (extra)."""
    missing = train.join(test, "feature", "left_anti").select("feature", F.lit("missing").alias("kind"))
    extra = test.join(train, "feature", "left_anti").select("feature", F.lit("extra").alias("kind"))
    return missing.unionByName(extra)


def class_weights(cases: DataFrame, label: str) -> DataFrame:
    """(label, n_cases, weight) with weight = cases / (classes * cases of the class)."""
    counts = cases.groupBy(label).agg(F.count(F.lit(1)).alias("n_cases"))
    totals = counts.agg(F.sum("n_cases").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    return counts.crossJoin(F.broadcast(totals)).select(  # one row
        label, "n_cases", (F.col("_all") / (F.col("_classes") * F.col("n_cases"))).alias("weight"))


def text_columns(wide: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    """Columns whose name starts with the prefix, null as ''."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    return wide.select(*keep, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])


def vectors(cases: DataFrame, cells: DataFrame, case: str, names: list[str], out: str = "features") -> DataFrame:
    """One sparse vector per case over the listed features.

    ``names`` is the fitted feature list: after the share cut at most
    1/share categories remain per column and event, so it is small. A case
    has at most one cell per listed feature, so its list is small too.
    """
    spark = cases.sparkSession
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, _i int")
    # A fixed partition count: vectors are small but scoring them is not, so they must not be merged into few tasks.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cells.join(F.broadcast(index), "feature").repartition(width, case).groupBy(case).agg(
        F.array_sort(F.collect_list(F.struct("_i", "number"))).alias("_cells"))
    empty = F.array().cast("array<struct<_i:int,number:double>>")
    joined = cases.repartition(width, case).join(placed, case, "left").withColumn("_cells", F.coalesce("_cells", empty))
    return joined.withColumn(out, sparse_vector("_cells._i", "_cells.number", len(names))).drop("_cells")
