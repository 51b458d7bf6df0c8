"""Cleaning and numeric expressions over single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in text (plain, signed, exponent, infinity).
NUMBER_PATTERN = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"
MISSING = "MISSING"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_timestamp(c, fmt: str | None = None) -> Column:
    """Parsed time; null where the text does not parse."""
    text = col(c)
    return F.try_to_timestamp(text) if fmt is None else F.try_to_timestamp(text, F.lit(fmt))


def epoch_seconds(c) -> Column:
    """Whole seconds since 1970 (floor); null stays null."""
    return F.unix_seconds(col(c).cast("timestamp"))


def text_flag(c) -> Column:
    """'true' in any case gives 1; everything else, null included, gives 0."""
    return F.when(F.lower(col(c)) == "true", 1).otherwise(0)


def number_or_zero(c) -> Column:
    """Number held in text; 0 where it is not one."""
    text = F.trim(col(c))
    return F.coalesce(F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")), F.lit(0.0))


def ratio(a, b) -> Column:
    """a / b with 0 where the division has no finite result."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def finite_or_zero(c) -> Column:
    """Null, NaN and both infinities become 0."""
    x = col(c)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def or_missing(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(MISSING))


def or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_max_index(probabilities) -> Column:
    """0-based index of the largest entry; the first one wins on ties."""
    p = col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def replace_values(c, mapping: dict[str, str]) -> Column:
    """Values found in the mapping are exchanged, all others kept."""
    if not mapping:
        return col(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, col(c)), col(c))


def sparse_vector(indices, values, size: int) -> Column:
    """An ML sparse vector from two parallel arrays, without a Python worker."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    body = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        col(indices).cast("array<int>").alias("indices"),
        col(values).cast("array<double>").alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(body.alias("v"))), schema)["v"]
