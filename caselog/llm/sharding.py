"""Shards of near equal bytes by a k-d tree over document metadata.

A node that must become m shards is cut where its bytes reach the share of its left half (m // 2 of m), along the
dimension that is widest in it: a weighted median for m = 2, a weighted quantile in general, so any number of shards
comes out even. The cut is found without sorting: executors add up bytes per bin between the node's bounds and the bin
that holds the cut is refined until it is light enough. Keys are 62-bit numbers, the value above and a hash of the row
below, so a value shared by a third of all rows is cut too. The driver sees one row per node and level; the tree has as
many leaves as there are shards, and all nodes of a level are cut together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.operators.ranks import row_number_by_slice
from caselog.session import Workspace, durable

BINS = 1024
LOW_BITS = 30
TOLERANCE = 0.002  # of a shard's bytes
FEW_NODES = 100_000


@dataclass
class Node:
    """A node of the tree: shards it still must become, and the first of their numbers."""

    first: int
    shards: int
    dim: str | None = None
    cut: int | None = None  # keys up to the cut go left
    bounds: tuple[int, int] | None = None
    below: float = 0.0
    weight: float = 0.0
    kids: list[Node] = field(default_factory=list)


def document_dims(id_col: str = "doc_id") -> dict[str, Column]:
    """Metadata of ``documents`` as numbers from 0 to 2^31: length (log scale), language, source, id."""
    top = float((1 << 31) - 1)
    code = lambda c: F.conv(F.substring(F.md5(F.coalesce(F.col(c), F.lit(""))), 1, 7), 16, 10).cast("long") * 8
    return {
        "length": F.least(F.lit(top), F.log1p(F.coalesce(F.col("size"), F.lit(0)).cast("double")) / 45.0 * top).cast("long"),
        "lang": code("lang"), "source": code("source"),
        "ident": F.pmod(F.coalesce(F.col(id_col), F.lit(0)).cast("long"), F.lit(1 << 31)),
    }


def _node_rows(spark, nodes: dict[int, Node]):
    rows = [(i, n.dim, n.cut, n.bounds[0] if n.bounds else None, n.bounds[1] if n.bounds else None) for i, n in nodes.items()]
    made = spark.createDataFrame(rows, "node long, dim string, cut long, lo long, hi long")
    # one row per node, at most as many as shards; far beyond, Spark decides, and no node is then large
    return F.broadcast(made) if len(rows) <= FEW_NODES else made


def _cut_level(keyed: DataFrame, dims: list[str], nodes: dict[int, Node], tolerance: float) -> None:
    """Choose dimension and cut of every node that still stands for several shards."""
    spark = keyed.sparkSession
    open_ = {i: n for i, n in nodes.items() if n.shards > 1}
    stats = keyed.join(_node_rows(spark, open_).select("node"), "node").groupBy("node").agg(
        F.sum("size").alias("w"), *[F.min(f"k_{d}").alias(f"lo_{d}") for d in dims], *[F.max(f"k_{d}").alias(f"hi_{d}") for d in dims])
    for r in stats.collect():  # a row per node
        n = open_[r["node"]]
        n.dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"], d))
        n.bounds, n.weight = (r[f"lo_{n.dim}"], r[f"hi_{n.dim}"]), float(r["w"])
    for n in open_.values():
        if n.bounds is None:  # no rows: either side will do
            n.dim, n.cut = dims[0], 0
    while seeking := {i: n for i, n in open_.items() if n.cut is None}:
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"k_{d}")) for d in dims])
        inside = keyed.join(_node_rows(spark, seeking), "node").withColumn("key", key).filter("key between lo and hi")
        sums = inside.groupBy("node", F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)").alias("bin"))
        sums = sums.agg(F.sum("size").alias("w"), F.max("key").alias("most"), F.min("key").alias("least"))
        running = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        goal = spark.createDataFrame([(i, n.weight * (n.shards // 2) / n.shards - n.below) for i, n in seeking.items()], "node long, goal double")
        placed = sums.withColumn("upto", F.sum("w").over(running)).join(goal, "node").filter("upto >= goal")
        hit = placed.groupBy("node").agg(F.min_by(F.struct("w", "upto", "most", "least", "goal"), "bin").alias("h")).select("node", "h.*")
        found = {r["node"]: r for r in hit.collect()}  # a row per node
        for i, n in seeking.items():
            r = found.get(i)
            if r is None:
                n.cut = n.bounds[1]
            elif r["w"] <= tolerance or r["most"] == r["least"]:
                before = r["upto"] - r["w"]
                n.cut = r["most"] if r["upto"] - r["goal"] <= r["goal"] - before else r["least"] - 1
            else:
                n.below += r["upto"] - r["w"]
                n.bounds = (r["least"], r["most"])


def grow_tree(keyed: DataFrame, dims: list[str], shards: int, tolerance: float) -> tuple[DataFrame, dict[int, Node]]:
    """Rows with their leaf in ``node``, and the leaves by number."""
    nodes = {1: Node(0, shards)}
    keyed = keyed.withColumn("node", F.lit(1).cast("long"))
    while any(n.shards > 1 for n in nodes.values()):
        _cut_level(keyed, dims, nodes, tolerance)
        step = _node_rows(keyed.sparkSession, {i: n for i, n in nodes.items()}).select(F.col("node").alias("at"), "dim", "cut")
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"k_{d}")) for d in dims])
        keyed = keyed.join(step, F.col("node") == F.col("at")).withColumn(
            "node", F.when(F.col("cut").isNull(), F.col("node") * 2).when(key <= F.col("cut"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)).drop("at", "dim", "cut")
        after: dict[int, Node] = {}
        for i, n in nodes.items():
            left = n.shards // 2 if n.shards > 1 else n.shards
            after[2 * i] = Node(n.first, left)
            if n.shards > 1:
                after[2 * i + 1] = Node(n.first + left, n.shards - left)
        nodes = after
    return keyed, nodes


def kd_shards(rows: DataFrame, dims: dict[str, Column], tie: Column, order: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``rows`` (with a ``size`` column) and their ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Give the number of shards, or the bytes a leaf may have at most: the tree then grows ceil(total / target) leaves.
    Shards differ by the largest row and a fraction of a percent. ``order`` names columns that order rows within a
    shard; rows equal in all of them and in the tie hash are interchangeable and stay together. Null sizes count 0,
    null dimensions must be mapped by the caller's expressions; an empty table gives an empty result. Columns named
    ``shard`` and ``slot`` are replaced, all other names are free.
    """
    with Workspace(rows.sparkSession) as space:
        # the caller's columns travel as one struct, so their names are free
        given = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).drop("shard", "slot")
        low = F.pmod(tie, F.lit(1 << LOW_BITS))
        keys = [(F.shiftleft(value.cast("long"), LOW_BITS) + low).alias(f"k_{name}") for name, value in dims.items()]
        inner = given.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("row"), F.col("size"), tie.alias("_tie"), *keys)
        keyed = space.table(inner, "meta")
        total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        if shards is None:
            shards = max(1, -(-total // target_bytes))
        placed, leaves = grow_tree(keyed, list(dims), shards, max(1.0, TOLERANCE * total / shards))
        numbers = rows.sparkSession.createDataFrame([(i, leaf.first) for i, leaf in leaves.items()], "leaf long, shard int")
        numbers = F.broadcast(numbers) if len(leaves) <= FEW_NODES else numbers
        slices = max(1, n // (shards * 50_000))
        sharded = placed.join(numbers, F.col("node") == F.col("leaf")).select("row", "_tie", "shard")
        ranked = row_number_by_slice(sharded, ["shard"], [F.col("row")[c] for c in order] + [F.col("_tie")], F.pmod(F.col("_tie"), F.lit(slices)), "slot")
        return durable(ranked.select("row.*", "shard", (F.col("slot") - 1).alias("slot")))


def write_shards(docs: DataFrame, placed: DataFrame, id_col: str, path: str) -> None:
    """Write whole documents into one folder per shard, in slot order within a file.

    ``placed`` gives each id one shard and slot; documents without one, such as those of a null id, are not written. Columns of
    ``docs`` named ``shard`` and ``slot`` are replaced.
    """
    joined = docs.drop("shard", "slot").join(placed.select(id_col, "shard", "slot"), id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
