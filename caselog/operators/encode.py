"""Prefix encoding: what is known of a case after its first k events.

The basis is a long table of cells (case, event number, feature, value),
built in one pass over the log. Wide rows and sparse vectors are made from
it. Names: ``{col}_event{n}_{value}``, ``event{n}_{value}``, ``{col}_event{n}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.functions.scalars import or_missing
from caselog.operators.events import first_known
from caselog.operators.features import small_table
from caselog.operators.ranks import rank_by_range

# Keyword groups for rare categories, tried in this order.
RARE_GROUPS = [
    (["business"], "Business"),
    (["boat", "motorcycle", "caravan"], "Vehicle Other"),
    (["debt", "restructuring"], "Debt Management"),
    (["tax"], "Tax and Payments"),
]
RARE_OTHER = "Other"
RARE_SHARE = 0.01

EVENT_NAME = ""  # source name of event-name cells


def rare_group(value: Column, groups=None, other: str = RARE_OTHER) -> Column:
    """Group name of a rare category by the first keyword found in it."""
    text = F.lower(value)
    out = F.lit(other)
    for keywords, name in reversed(RARE_GROUPS if groups is None else groups):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | text.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def category_shares(log: DataFrame, case: str, nr: str, column: str) -> DataFrame:
    """Cases per value (first known value of each case) and share of all cases."""
    firsts = log.groupBy(case).agg(first_known(column, nr).alias("value"))
    counts = firsts.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))


class RareCategories:
    """Values below a share of the training cases are grouped by keyword."""

    def __init__(self, column: str, threshold: float = RARE_SHARE, groups=None, other: str = RARE_OTHER):
        if not 0 < threshold <= 1:  # at most 1/threshold values reach it
            raise ValueError(f"a threshold lies above 0 and up to 1, not {threshold}")
        self.column, self.threshold, self.groups, self.other = column, threshold, groups, other
        self.table: DataFrame | None = None
        self.mapping: DataFrame | None = None
        self.frequent: list[str] | None = None

    @classmethod
    def of(cls, column: str, table: DataFrame, threshold: float = RARE_SHARE) -> "RareCategories":
        """The fitted grouping that ``table`` holds: (value, replacement), null for a frequent value."""
        out = cls(column, threshold)
        out._hold(table)
        return out

    def _hold(self, table: DataFrame) -> None:
        self.table, self.mapping = table, table.filter("replacement is not null")
        self.frequent = [r[0] for r in small_table(table.filter("replacement is null").select("value"), int(1 / self.threshold) + 1)]

    def fit(self, log: DataFrame, case: str, nr: str) -> "RareCategories":
        shares = category_shares(log, case, nr, self.column).filter(F.col("value").isNotNull())
        rare = F.when(F.col("share") < self.threshold, rare_group(F.col("value"), self.groups, self.other))
        self._hold(shares.select("value", rare.alias("replacement")))
        return self

    def transform(self, log: DataFrame, spread: str) -> DataFrame:
        """Frequent values bypass the join on a key spread by column ``spread``,
        so that no join task gets all rows of a common value."""
        if self.mapping is None:
            raise ValueError("fit before transform")
        c = F.col(self.column)
        bypass = c.isin(self.frequent) | c.isNull()
        key = F.when(bypass, F.concat(F.lit("\u0001"), F.col(spread).cast("string"))).otherwise(c)
        right = self.mapping.select(F.col("value").alias("_k"), "replacement")
        joined = log.withColumn("_k", key).join(right, "_k", "left")
        return joined.withColumn(self.column, F.coalesce("replacement", c)).select(*log.columns)


def feature_name(source: Column, nr: Column, value: Column) -> Column:
    n = nr.cast("string")
    named = F.concat(source, F.lit("_event"), n, F.lit("_"), value)
    return F.when(source == EVENT_NAME, F.concat(F.lit("event"), n, F.lit("_"), value)).otherwise(named)


def category_cells(log: DataFrame, case: str, nr: str, k: int, event_col: str | None, cat_cols: list[str]) -> DataFrame:
    """(case, nr, source, value, feature): one cell per categorical column and event up to k."""
    items = [F.struct(F.lit(c if c != event_col else EVENT_NAME).alias("source"), or_missing(c).alias("value"))
             for c in ([event_col] if event_col else []) + list(cat_cols)]
    cells = log.filter(F.col(nr) <= k).select(case, nr, F.inline(F.array(*items)))
    return cells.withColumn("feature", feature_name(F.col("source"), F.col(nr), F.col("value")))


def number_cells(log: DataFrame, case: str, nr: str, k: int, dynamic_cols: list[str]) -> DataFrame:
    """(case, nr, feature, number): one cell per dynamic column and event up to k; null counts as 0."""
    items = [F.struct(F.lit(c).alias("source"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("number"))
             for c in dynamic_cols]
    cells = log.filter(F.col(nr) <= k).select(case, nr, F.inline(F.array(*items)))
    name = F.concat("source", F.lit("_event"), F.col(nr).cast("string"))
    return cells.select(case, nr, name.alias("feature"), "number")


def all_cells(log, case, nr, k, event_col=None, cat_cols=(), dynamic_cols=()) -> DataFrame:
    """Long form of the encoded log: (case, nr, feature, number) without zero cells."""
    parts = []
    if event_col or cat_cols:
        parts.append(category_cells(log, case, nr, k, event_col, list(cat_cols)).select(
            case, nr, "feature", F.lit(1.0).alias("number")))
    if dynamic_cols:
        parts.append(number_cells(log, case, nr, k, list(dynamic_cols)).filter("number <> 0"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def vocabulary(cells: DataFrame, nr: str) -> DataFrame:
    """Distinct (source, nr, value) of categorical cells, indexed in sorted order per (source, nr)."""
    seen = cells.groupBy("source", nr, "value").agg(F.count(F.lit(1)).alias("n_cells"), F.max("feature").alias("feature"))
    indexed = rank_by_range(seen, [F.col("value")], "idx", by=["source", nr])
    return indexed.withColumn("idx", F.col("idx") - 1)


def wide_numbers(log: DataFrame, case: str, nr: str, k: int, dynamic_cols: list[str], keep_short: bool = False,
                 length: str = "case_length") -> DataFrame:
    """One row per case with ``{col}_event{n}``; one conditional aggregate, zeros for gaps."""
    rows = log if keep_short else log.filter(F.col(length) >= k)
    aggs = [F.coalesce(F.max(F.when(F.col(nr) == n, F.col(c).cast("double"))), F.lit(0.0)).alias(f"{c}_event{n}")
            for c in dynamic_cols for n in range(1, k + 1)]
    return rows.filter(F.col(nr) <= k).groupBy(case).agg(*aggs)


def wide_one_hot(log: DataFrame, case: str, nr: str, entries: list[tuple[str, int, str]], keep_short: bool = False,
                 length: str = "case_length", names: dict | None = None) -> DataFrame:
    """One row per case with a 0/1 column per vocabulary entry (source, nr, value).

    ``names`` maps the event-name source to its column. For few entries only;
    models use sparse vectors instead.
    """
    k = max(n for _, n, _ in entries)
    rows = log if keep_short else log.filter(F.col(length) >= k)
    aggs = []
    for source, n, value in entries:
        column = (names or {}).get(source, source)
        name = f"event{n}_{value}" if source == EVENT_NAME else f"{source}_event{n}_{value}"
        hit = (F.col(nr) == n) & (or_missing(column) == value)
        aggs.append(F.max(F.when(hit, 1.0).otherwise(0.0)).alias(name))
    return rows.filter(F.col(nr) <= k).groupBy(case).agg(*aggs)


def static_block(log: DataFrame, case: str, nr: str, columns: list[str], k: int | None = None) -> DataFrame:
    """First known value per case, within the prefix k (or the whole case when None)."""
    rows = log if k is None else log.filter(F.col(nr) <= k)
    return rows.groupBy(case).agg(*[first_known(c, nr).alias(c) for c in columns])


def last_state_block(log: DataFrame, case: str, nr: str, columns: list[str], k: int) -> DataFrame:
    """Value of each column at the last event of the prefix k."""
    return log.filter(F.col(nr) <= k).groupBy(case).agg(*[F.max_by(c, nr).alias(c) for c in columns])


def ordinal_block(log: DataFrame, case: str, nr: str, k: int, codes: DataFrame, column: str) -> DataFrame:
    """``{col}_event{n}`` holding the code of the value; 0 for absent events, unseen values and gaps.

    Codes start at 1. ``codes`` has (column, code) from ``clean.ordinal_table``.
    """
    coded = log.filter(F.col(nr) <= k).join(codes, column, "left").withColumn("_c", F.coalesce(F.col("code") + 1, F.lit(0)))
    aggs = [F.coalesce(F.max(F.when(F.col(nr) == n, F.col("_c"))), F.lit(0)).cast("bigint").alias(f"{column}_event{n}")
            for n in range(1, k + 1)]
    return coded.groupBy(case).agg(*aggs)


def zero_fill(df: DataFrame) -> DataFrame:
    """0 for missing numbers, '' for missing text."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.na.fill(0, numbers).na.fill("", [c for c, t in df.dtypes if t == "string"])
