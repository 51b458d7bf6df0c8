"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.session import Workspace


def components(edges: DataFrame, space: Workspace, most_rounds: int = 64) -> DataFrame:
    """(node, label) of every node in ``edges`` (columns a, b): label is the smallest node of its component.

    Large star: every node hands its larger neighbours to its smallest neighbour. Small star: every node hands its
    smaller neighbours to the smallest one. Each is a grouped minimum (partial on the map side) and a join back, so
    the centre of a large group is never gathered in one task. Stops when a round changes nothing; the rounds grow
    with the logarithm of the nodes.
    """
    now = space.table(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.withColumnRenamed("lo", "u").join(least, "u").select(F.col("m").alias("lo"), "hi").filter("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).filter("lo <> hi").distinct()
        spent, now = now, space.table(small, "edges")
        space.drop(spent)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(roots)
