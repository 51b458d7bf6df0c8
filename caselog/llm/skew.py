"""A left join to a table of groups when a few groups hold much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, p: str) -> DataFrame:
    """``rows`` with a column ``{p}{c}`` for every column c of ``groups``, null where no group has the row's ``key``.

    ``groups`` has each key (text without a leading "-") once and ``size``, the rows it stands for; it is read three times, so it should
    be a written table. Groups above 1/1024 of the grouped rows, so at most 1024 of them, are broadcast; their rows then carry a key of
    their own (``spread``), so that the shuffled join with the other groups is even.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT_PARTS > total).select(*[F.col(c).alias(f"{p}hot_{c}") for c in groups.columns])
    cold = groups.filter(F.col(size) * HOT_PARTS <= total).select(*[F.col(c).alias(f"{p}cold_{c}") for c in groups.columns])
    found = rows.join(F.broadcast(hot), F.col(key) == F.col(f"{p}hot_{key}"), "left")  # 1024 rows at most
    own = F.when(F.col(f"{p}hot_{key}").isNotNull(), F.concat(F.lit("-"), spread.cast("string"))).otherwise(F.col(key))
    found = found.withColumn(f"{p}own", own).join(cold, F.col(f"{p}own") == F.col(f"{p}cold_{key}"), "left")
    both = {f"{p}{c}": F.coalesce(F.col(f"{p}hot_{c}"), F.col(f"{p}cold_{c}")) for c in groups.columns}
    return found.withColumns(both).drop(f"{p}own", *[f"{p}{side}_{c}" for side in ("hot", "cold") for c in groups.columns])
