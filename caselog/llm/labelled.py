"""Labelled rows for the classifiers: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text is a multiple of five; such rows are never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, text, y) of labelled rows outside the held-out fold, about ``most`` of them at any input size.

    The rows are those with the smallest hash of the id, so the sample repeats on every cluster. ``most`` also bounds
    the broadcast side of the join; an id labelled twice counts once, with the larger label. Null labels are left out.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < int(0.97 * most / n * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "id")  # at most about ``most`` rows of two numbers
