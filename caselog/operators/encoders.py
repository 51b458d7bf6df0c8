"""The encoders a log specification selects: rare groups, then one-hot or ordinal categories, then last states.

Everything is fitted on the training log only. The tables go from ``fit_codes`` through the model to every scored log and are
saved with it: ``rare__{column}`` holds (value, replacement), null for a frequent value; ``{column}`` holds (column, code, n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.operators.clean import ordinal_table
from caselog.operators.encode import RareCategories
from caselog.operators.ranks import lookup_skewed
from caselog.session import durable

METHODS = ("onehot", "ordinal", "label")
RARE = "rare__"


def string_columns(log: DataFrame, columns) -> list[str]:
    kinds = dict(log.dtypes)
    return [c for c in columns if kinds[c] == "string"]


def categories(spec) -> list[str]:
    """Columns with a category per event; the label method has none."""
    if spec.encoding_method not in METHODS:
        raise ValueError(f"encoding_method is one of {METHODS}, not {spec.encoding_method!r}")
    return [] if spec.encoding_method == "label" else ([spec.event_col] if spec.event_col else []) + list(spec.cat_cols)


def event_codes(log: DataFrame, spec) -> list[str]:
    """Columns whose events carry a code: the categories of the ordinal method, and last states of text without one-hot names."""
    if spec.encoding_method == "onehot":
        return []
    return list(dict.fromkeys([*categories(spec), *string_columns(log, spec.last_state_cols)]))


def fitted_per_event(spec) -> bool:
    """Whether event values depend on the training log, so that folds cannot share their case rows."""
    return bool(spec.rare_cols) or spec.encoding_method == "ordinal" or (spec.encoding_method == "label" and bool(spec.last_state_cols))


def fit_codes(log: DataFrame, spec) -> dict[str, DataFrame]:
    """Rare groups, then ordinal codes of static text columns and of coded event columns; kept, since every scoring reads them."""
    tables = {}
    for c in spec.rare_cols:
        tables[RARE + c] = durable(RareCategories(c, spec.rare_share).fit(log, spec.case, spec.nr).table)
    grouped = group_rare(log, spec, tables)
    coded = event_codes(log, spec)
    for c in dict.fromkeys([*string_columns(log, spec.static_cols), *coded]):
        codes = ordinal_table(grouped, c)
        if c in coded:
            codes = codes.join(grouped.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c)
        tables[c] = durable(codes)
    return tables


def group_rare(log: DataFrame, spec, tables: dict[str, DataFrame]) -> DataFrame:
    """Rare values of the training log exchanged for their group; values it never had stay."""
    for c in spec.rare_cols:
        log = RareCategories.of(c, tables[RARE + c], spec.rare_share).transform(log, spec.case)
    return log


def encode_events(log: DataFrame, spec, tables: dict[str, DataFrame]) -> DataFrame:
    """The log with rare values grouped and a number ``_code_{c}`` per coded column: 1 + code, 0 for null and for unseen values."""
    coded = event_codes(log, spec)
    log = group_rare(log, spec, tables)
    for c in coded:
        table = tables[c].select(F.col(c).cast("string").alias("_v"), F.col("code").alias("_code"), F.col("n").alias("_n"))
        # null never matches and must not meet in one task
        value = F.coalesce(F.col(c).cast("string"), F.concat(F.lit("\u0001"), F.col(spec.case).cast("string")))
        found = lookup_skewed(log.withColumn("_v", value), table, "_v", "_n", F.col(spec.case))
        log = found.withColumn(f"_code_{c}", F.coalesce(F.col("_code") + 1, F.lit(0)).cast("double")).drop("_v", "_code", "_n")
    return log


def event_numbers(spec) -> list[tuple[str, str]]:
    """(column, stem) of the numbers each event carries; its feature is the stem, the event number in place of ``{n}``."""
    if spec.encoding_method == "label":
        return []
    plain = [(c, f"{c}_event{{n}}") for c in spec.dynamic_cols]
    if spec.encoding_method == "onehot":
        return plain
    return plain + [(f"_code_{c}", "event{n}" if c == spec.event_col else f"{c}_event{{n}}") for c in categories(spec)]
