"""From raw rows to a numbered event log, and aggregates per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.operators.ranks import HOT_ROWS, hot_keys


def number_events(
    df: DataFrame,
    case: str,
    order: list[Column],
    slice_: Column,
    nr: str = "event_nr",
    length: str | None = "case_length",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """Event number inside each case, and the case length, in one window.

    ``order`` must be total. ``slice_`` must not decrease along it (the time
    cut to the hour, say): cases above hot_rows rows are numbered slice by
    slice. ``hot`` takes the result of ``hot_keys`` when already known.
    """
    if isinstance(hot, str):
        hot = hot_keys(df, case, hot_rows)
    if hot is None:
        out = df.withColumn(nr, F.row_number().over(Window.partitionBy(case).orderBy(*order)))
        if length:
            out = out.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(case)))
        return out

    marked = df.join(F.broadcast(hot), case, "left").withColumn("_s", F.when(F.col("_total").isNotNull(), slice_))
    sizes = marked.filter(F.col("_total").isNotNull()).groupBy(case, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(case).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(case, F.col("_s").alias("_s2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = marked.withColumn("_r", F.row_number().over(Window.partitionBy(case, "_s").orderBy(*order)))
    if length:
        inside = F.count(F.lit(1)).over(Window.partitionBy(case, "_s"))
        local = local.withColumn(length, F.coalesce(F.col("_total"), inside))
    right = starts.withColumnRenamed(case, "_case2")
    joined = local.join(right, (F.col(case) == F.col("_case2")) & (F.col("_s") == F.col("_s2")), "left")
    return joined.withColumn(nr, (F.col("_r") + F.coalesce(F.col("_start"), F.lit(0))).cast("int")).drop(
        "_total", "_s", "_r", "_case2", "_s2", "_start")


def duplicate_keys(df: DataFrame, case: str, nr: str) -> DataFrame:
    """(case, event number) pairs that occur more than once."""
    return df.groupBy(case, nr).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def require_unique_events(df: DataFrame, case: str, nr: str) -> DataFrame:
    """The table itself, or an error when an event number repeats in a case."""
    if not duplicate_keys(df, case, nr).isEmpty():
        raise ValueError(f"({case}, {nr}) is not unique; number the events first or keep the first of each")
    return df


def keep_first_event(df: DataFrame, case: str, nr: str, order: list[str]) -> DataFrame:
    """One row per (case, event number): the first along ``order``."""
    rest = [c for c in df.columns if c not in (case, nr)]
    best = df.groupBy(case, nr).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(case, nr, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_known(c: str, nr: str) -> Column:
    """Aggregate: value of the earliest event where it is not null."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(nr)))


def last_known(c: str, nr: str) -> Column:
    """Aggregate: value of the latest event where it is not null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(nr)))


def case_table(df: DataFrame, case: str, nr: str, columns: list[str]) -> DataFrame:
    """One row per case with the first known value of every column."""
    return df.groupBy(case).agg(*[first_known(c, nr).alias(c) for c in columns])


def last_state(df: DataFrame, case: str, order: str, columns: list[str]) -> DataFrame:
    """One row per case with the last known value of every column along ``order``."""
    return df.groupBy(case).agg(*[last_known(c, order).alias(c) for c in columns])


def case_outcome(df: DataFrame, case: str, flag: Column, positive="successful", negative="unsuccessful") -> DataFrame:
    """Outcome per case: positive when the flag holds at any event."""
    hit = F.bool_or(F.coalesce(flag, F.lit(False)))
    return df.groupBy(case).agg(F.when(hit, positive).otherwise(negative).alias("label"))


def with_case_value(df: DataFrame, case: str, values: DataFrame) -> DataFrame:
    """Attach a one-row-per-case table to every event."""
    return df.join(values, case, "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and the share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))


def describe_lengths(df: DataFrame, case: str, length: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of case lengths.

    Lengths are grouped first, so the exact percentiles see one weighted
    value per distinct length.
    """
    sizes = df.groupBy(case).agg(F.max(length).cast("double").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    n, s = F.sum("n"), F.sum(F.col("x") * F.col("n"))
    ss = F.sum(F.col("x") * F.col("x") * F.col("n"))
    q = F.expr("percentile(x, array(0.25D, 0.5D, 0.75D), n)")
    return sizes.agg(
        n.alias("n"), (s / n).alias("mean"), F.sqrt((ss - s * s / n) / (n - 1)).alias("std"),
        F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"),
    ).select("n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
             F.col("q")[2].alias("q75"), "max")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls. One pass over the table."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                               F.col("_rows").alias("n_rows"), F.col(c).alias("n_nulls")) for c in cols])
    return row.select(F.inline(cells))
