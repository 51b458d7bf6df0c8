"""Exact ranks and running values without gathering a group in one task.

A plain window sorts a whole group in one task, so one case, class or a
table without groups would end on a single executor. Here the order is cut
into slices by an expression that never decreases along it. Rows are ranked
inside (group, slice); the start of each slice comes from a count per slice,
a table of groups x slices rows. Slices are pure functions of the row, so
a lost executor recomputes the same answer. Where the values themselves say
no such expression, ranges are sampled and the sorted rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.session import durable

HOT_ROWS = 1_000_000
HOT_BUCKETS = 1 << 16  # keys are counted by hash first


def row_number_by_slice(df: DataFrame, by: list[str], order: list[Column], slice_: Column, out: str) -> DataFrame:
    """``row_number() over (partition by by order by order)`` computed per slice.

    No broadcast hint: the counts are joined on the window's own keys, so the
    big side is not shuffled again whichever join Spark picks.
    """
    group = F.struct(*by) if by else F.lit(0)  # struct keys also match null with null
    cut = df.withColumn("_g", group).withColumn("_s", F.struct(slice_.alias("s")))  # a struct: a null slice is a slice
    sizes = cut.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_g", "_s").orderBy(*order)
    ranked = cut.withColumn("_r", F.row_number().over(inside))
    return (
        ranked.join(starts, ["_g", "_s"])
        .withColumn(out, (F.col("_start") + F.col("_r")).cast("bigint"))
        .drop("_g", "_s", "_r", "_start")
    )


def in_ranges(df: DataFrame, order: list[Column], slices: int | None = None) -> DataFrame:
    """The table sorted across its partitions, with ``_at``: the partition in the high bits, the place in it in the low 33.

    Spark samples the order for even ranges, whatever the type or spread of its values: a far outlier, a shared beginning and any
    script make no difference. The rows are kept (``durable``), for the bounds of a second shuffle would be others. Rows that
    agree in all of ``order`` share a range, so a value of many rows needs a tie column behind it.
    """
    spread = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return durable(spread.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def rank_by_range(df: DataFrame, order: list[Column], out: str, by: list[str] = (), slices: int | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)`` from one range shuffle: places in a range plus the sizes of the ranges before.

    For few groups: each must have its start in a table of its own.
    """
    placed = in_ranges(df, [*(F.col(c) for c in by), *order], slices).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # one row per partition
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.join(F.broadcast(starts), "_part").withColumn(out, place.cast("bigint")).drop("_part", "_at", "_start")
    if not by:
        return ranked
    keyed = ranked.withColumn("_g", F.struct(*by))  # struct keys also match null with null
    firsts = keyed.groupBy("_g").agg(F.min(out).alias("_first"))
    return keyed.join(firsts, "_g").withColumn(out, F.col(out) - F.col("_first") + 1).drop("_g", "_first")


def contiguous_ids(df: DataFrame, key: str, out: str, tie: str | None = None, slices: int | None = None) -> DataFrame:
    """1..N in the order of a key of any type, then of a ``tie`` column, along which a frequent value is cut."""
    order = [F.col(key)] + ([F.col(tie)] if tie else [])
    return rank_by_range(df, order, out, slices=slices).select(*df.columns, out)


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys held by more than hot_rows rows, or None when there are none.

    Counts hash buckets of that column alone, which are few and need hardly a
    shuffle: a key of so many rows has its bucket above hot_rows. Only when
    there is such a bucket are the keys counted, those of these buckets. The
    plan for the usual log (no such case) stays a single window. The result
    has at most rows/hot_rows rows.
    """
    bucket = F.pmod(F.hash(key), F.lit(HOT_BUCKETS))
    full = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    buckets = [r["_b"] for r in full.select("_b").collect()]  # HOT_BUCKETS at most
    if not buckets:
        return None
    hot = df.filter(bucket.isin(buckets)).groupBy(key).agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") > hot_rows)
    return None if hot.isEmpty() else hot


def running_in_case(
    df: DataFrame,
    case: str,
    nr: str,
    values: dict[str, tuple[str, str]],
    slice_rows: int | None = HOT_ROWS,
    order: list[Column] | None = None,
) -> DataFrame:
    """Running values per case along its event numbers.

    ``values`` maps an output name to (kind, column) with kind one of
    sum, max, first, last; first and last skip nulls. With slice_rows set,
    cases longer than that run slice by slice, the earlier slices carried in.
    Pass None when no case is that long (see ``hot_keys``). ``order`` is the
    order the numbers were given by: the plain window then shares its sort.
    """
    simple = {"sum": F.sum, "max": F.max}

    def windowed(kind, source, w):
        if kind in simple:
            return simple[kind](source).over(w)
        pick = F.first if kind == "first" else F.last
        return pick(source, ignorenulls=True).over(w)

    if slice_rows is None:
        plain = Window.partitionBy(case).orderBy(*(order or [F.col(nr)])).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: windowed(k, c, plain) for o, (k, c) in values.items()})

    def summary(kind, source):
        if kind in simple:
            return simple[kind](source)
        seen = F.when(F.col(source).isNotNull(), F.col(nr))
        return F.min_by(source, seen) if kind == "first" else F.max_by(source, seen)

    cut = df.withColumn("_s", F.floor((F.col(nr) - 1) / slice_rows).cast("bigint"))
    inside = Window.partitionBy(case, "_s").orderBy(nr).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_w_{o}": windowed(k, c, inside) for o, (k, c) in values.items()})

    totals = cut.groupBy(case, "_s").agg(*[summary(k, c).alias(f"_t_{o}") for o, (k, c) in values.items()])
    before = Window.partitionBy(case).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        case, "_s", *[windowed(k, f"_t_{o}", before).alias(f"_c_{o}") for o, (k, _) in values.items()]
    ).filter(F.col("_s") > 0)  # one row per further slice of a long case

    joined = local.join(carried, [case, "_s"], "left")
    merged = {}
    for o, (k, _) in values.items():
        w, c = F.col(f"_w_{o}"), F.col(f"_c_{o}")
        if k == "sum":
            merged[o] = F.when(c.isNull(), w).otherwise(c + F.coalesce(w, F.lit(0)))
        elif k == "max":
            merged[o] = F.greatest(w, c)
        else:
            merged[o] = F.coalesce(c, w) if k == "first" else F.coalesce(w, c)
    helper = ["_s"] + [f"_{p}_{o}" for o in values for p in "wc"]
    return joined.withColumns(merged).drop(*helper)


def lookup_skewed(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a unique-key table when a few keys hold much of the facts.

    ``weight`` is the number of fact rows per key, known to the table. Keys
    above hot_rows (at most facts/hot_rows of them) are broadcast; their rows
    get a never-matching join key spread over ``spread``, so the shuffled
    join sees only moderate keys. Every fact row stays exactly once.
    """
    extra = [c for c in table.columns if c != key]
    hot = table.filter(F.col(weight) > hot_rows).select(
        key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in extra])
    cold = table.filter(F.col(weight) <= hot_rows).select(F.col(key).alias("_k"), *extra)
    step = facts.join(F.broadcast(hot), key, "left")
    join_key = F.when(F.col("_hot"), F.concat(F.lit("\u0001"), spread.cast("string"))).otherwise(F.col(key))
    # a key is shuffled once: as the join key, or beside it where that is another
    merged = step.withColumn("_k", join_key).withColumn(key, F.when(F.col("_hot"), F.col(key))).join(cold, "_k", "left")
    picked = {c: F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(c)) for c in extra}
    picked[key] = F.when(F.col("_hot"), F.col(key)).otherwise(F.col("_k").cast(facts.schema[key].dataType))
    return merged.withColumns(picked).drop("_k", "_hot", *[f"_h_{c}" for c in extra])
