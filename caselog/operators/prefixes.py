"""One row per case for all prefixes: what is known after k events is an index range of it.

A case row holds its categorical cells as names in event order with the number of names known after each event, its
numbers laid out by event, and its static values with the event where each is first known. Prefix k is a slice of the names,
a slice of the numbers and a comparison; no prefix needs a shuffle of its own. Counts per (feature, case length, fold) give the
features of every prefix and of every training fold by sums, so folds and settings share one encoding too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.functions.scalars import or_missing
from caselog.operators import encode, encoders
from caselog.operators.events import first_known
from caselog.operators.features import small_table

MOST_NAMES = 1_000_000  # (fold, prefix, feature) rows the driver may hold; more raise
CASES_A_TASK = 20_000


def case_rows(log: DataFrame, spec, k_max: int, codes: list[dict[str, DataFrame]], extra: tuple[str, ...] = ()) -> DataFrame:
    """(case, label, length, extra..., names, ends, numbers, statics), one row per case, from one aggregate over the log.

    ``names`` are the categorical features up to event k_max in event order and ``ends[k - 1]`` of them are known after k
    events; ``numbers`` has one entry per (event, dynamic or coded column), 0 where unknown; ``statics[v]`` are (at, number) per
    static column, with the text codes of variant v of ``codes``. ``extra`` columns are constant per case. With last-state columns,
    ``last_names[k - 1]`` and ``last_numbers[k - 1]`` are those of the last event up to k. ``log`` comes from ``encoders.encode_events``.
    """
    nr = F.col(spec.nr)
    cats = encoders.categories(spec) if spec.encoding_method == "onehot" else []
    named = [encode.feature_name(F.lit(c if c != spec.event_col else encode.EVENT_NAME), nr, or_missing(c)) for c in cats]
    dynamic = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, _ in encoders.event_numbers(spec)]
    strings = encoders.string_columns(log, [*spec.static_cols, *spec.last_state_cols])
    last_named = [c for c in spec.last_state_cols if c in strings and spec.encoding_method == "onehot"]
    last_names = [F.concat(F.lit(f"{c}_last_"), or_missing(c)) for c in last_named]
    last_numbers = [F.lit(0.0) if c in last_named else F.coalesce(F.col(f"_code_{c}" if f"_code_{c}" in log.columns else c).cast("double"), F.lit(0.0))
                    for c in spec.last_state_cols]
    lasts = [_typed(last_names, "string").alias("last_names"), _typed(last_numbers, "double").alias("last_numbers")] if spec.last_state_cols else []
    event = F.struct(nr.cast("int").alias("nr"), _typed(named, "string").alias("names"), _typed(dynamic, "double").alias("numbers"), *lasts)
    known = {c: F.when(F.col(c).isNotNull(), nr) for c in spec.static_cols}
    found = log.groupBy(spec.case).agg(
        first_known(spec.label, spec.nr).alias(spec.label), F.max(nr).cast("int").alias(spec.length), *[F.max(c).alias(c) for c in extra],
        F.array_sort(F.collect_list(F.when(nr <= k_max, event))).alias("_events"),  # at most k_max events of a case
        *[first_known(c, spec.nr).alias(f"_s_{c}") for c in spec.static_cols], *[F.min(known[c]).cast("int").alias(f"_at_{c}") for c in spec.static_cols])
    variants = []
    for v, tables in enumerate(codes):
        numbers = []
        for c in spec.static_cols:
            value = F.col(f"_s_{c}")
            if c in tables and c in strings:
                coded = tables[c].select(F.col(c).alias(f"_v_{v}_{c}"), F.col("code").alias(f"_code_{v}_{c}"))
                size = tables[c].agg(F.count(F.lit(1)).alias(f"_n_{v}_{c}"))
                found = found.join(coded, value == F.col(f"_v_{v}_{c}"), "left").crossJoin(F.broadcast(size))  # one row
                numbers.append(F.when(value.isNotNull(), (F.coalesce(F.col(f"_code_{v}_{c}"), F.col(f"_n_{v}_{c}")) + 1).cast("double")))
            else:
                numbers.append(value.cast("double"))
        at = (lambda c: F.when(F.col(f"_at_{c}").isNotNull(), F.lit(1))) if spec.whole_case else (lambda c: F.col(f"_at_{c}"))
        items = [F.struct(at(c).alias("at"), F.coalesce(n, F.lit(0.0)).alias("number")) for c, n in zip(spec.static_cols, numbers)]
        variants.append(F.array(*items) if items else F.array().cast("array<struct<at:int,number:double>>"))
    zeros = F.array(*[F.lit(0.0) for _ in dynamic]) if dynamic else F.array().cast("array<double>")
    upto = F.sequence(F.lit(1), F.lit(max(k_max, 1)))
    nrs = F.col("_events.nr")  # in order
    reached = F.greatest(F.coalesce(F.least(F.col(spec.length), F.lit(k_max)), F.lit(0)), F.lit(0))  # behind its last event a case has zeros
    at_number = F.transform(F.slice(upto, F.lit(1), reached), lambda n: F.coalesce(F.get("_events", F.array_position(nrs, n).cast("int") - 1)["numbers"], zeros))
    at_number = F.concat(at_number, F.array_repeat(zeros, F.lit(max(k_max, 1)) - reached))
    # events numbered 1, 2, ... need no search; others (gaps, repeated numbers) are counted one by one
    plain = (F.size(nrs) > 0) & (nrs == F.sequence(F.lit(1), F.greatest(F.size(nrs), F.lit(1))))
    ends = F.when(plain, F.transform(upto, lambda n: F.least(n, F.size("_events")) * len(cats))).otherwise(
        F.transform(upto, lambda n: F.size(F.filter(nrs, lambda e: e <= n)) * len(cats)))

    def last_upto(n: Column) -> Column:
        known = F.filter("_events", lambda e: e["nr"] <= n)
        return F.get(known, F.size(known) - 1)

    last_states = []
    if spec.last_state_cols:
        last_states = [F.transform(upto, lambda n: F.coalesce(last_upto(n)["last_names"], _typed([], "string"))).alias("last_names"),
                       F.transform(upto, lambda n: F.coalesce(last_upto(n)["last_numbers"], _typed([], "double"))).alias("last_numbers")]
    return found.select(spec.case, spec.label, spec.length, *extra, F.flatten(F.col("_events.names")).alias("names"), ends.alias("ends"),
                        F.flatten(at_number).alias("numbers"), F.array(*variants).alias("statics"), *last_states)


def _typed(entries: list[Column], kind: str) -> Column:
    return F.array(*entries) if entries else F.array().cast(f"array<{kind}>")


@dataclass
class Selection:
    """Features, cases and class sizes of the training cases of every prefix, for one training part."""

    categories: dict[int, list[str]] = field(default_factory=dict)
    numbers: dict[int, list[int]] = field(default_factory=dict)
    lasts: dict[int, list[int]] = field(default_factory=dict)
    classes: dict[int, dict] = field(default_factory=dict)

    def cases(self, k: int) -> int:
        return sum(self.classes.get(k, {}).values())


def select_features(rows: DataFrame, spec, k_max: int, folds: int = 0) -> list[Selection]:
    """A ``Selection`` over all cases, or one per fold over the cases outside it (column ``fold``), from one count of the rows.

    A feature counts for prefix k in the cases that reach k (all cases with ``keep_short``); those of a share of ``min_share``
    stay. The counts outside a fold are the counts of all less the fold's own.
    """
    parts = max(folds, 1)
    outside = [F.lit(True) if folds == 0 else F.col("fold") != f for f in range(parts)]
    length = F.least(F.col(spec.length), F.lit(k_max))
    first, last = F.lit(1), F.lit(k_max) if spec.keep_short else length
    keys = ["fold"] if folds else []
    sized = rows.groupBy(length.alias("_len"), spec.label, *keys).agg(F.count(F.lit(1)).alias("n"))
    reach = F.explode(F.sequence(first, F.lit(k_max) if spec.keep_short else F.col("_len"))).alias("k")
    by_class = sized.select(reach, spec.label, "n", *keys).groupBy("k", spec.label).agg(
        F.array(*[F.coalesce(F.sum(F.when(o, F.col("n"))), F.lit(0)) for o in outside]).alias("n"))
    out = [Selection() for _ in range(parts)]
    for r in small_table(by_class, MOST_NAMES):
        for f, n in enumerate(r["n"]):
            if n:
                out[f].classes.setdefault(r["k"], {})[r[spec.label]] = n

    width = len(encoders.event_numbers(spec))
    cats = len(encoders.categories(spec)) if spec.encoding_method == "onehot" else 0
    none = F.array().cast("array<struct<nr:int,name:string,place:int>>")
    # the event of each name, from the ends: event n has those from the end of event n - 1 on
    within = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))  # a case has nothing behind its last event
    at = F.flatten(F.transform(F.slice("ends", F.lit(1), within), lambda e, i: F.array_repeat((i + 1).cast("int"), e - F.coalesce(F.get("ends", i - 1), F.lit(0)))))
    named = F.arrays_zip(at.alias("nr"), F.col("names").alias("name"))
    names = F.transform(named, lambda x: F.struct(x["nr"].alias("nr"), x["name"].alias("name"), F.lit(-1).alias("place"))) if cats else none
    mine = F.slice("numbers", F.lit(1), within * max(width, 1))
    cells = F.transform(mine, lambda x, i: F.when(x != 0, F.struct((F.floor(i / max(width, 1)) + 1).cast("int").alias("nr"), F.lit("").alias("name"), i.alias("place"))))
    cells = F.filter(cells, lambda c: c.isNotNull()) if width else none
    met = rows.select(length.alias("_len"), *keys, F.inline(F.concat(names, cells, *(_last_cells() if spec.last_state_cols else []))))
    counted = met.groupBy("_len", "nr", "name", "place", *keys).agg(F.count(F.lit(1)).alias("n"))
    upto = F.lit(k_max) if spec.keep_short else F.col("_len")
    until = F.when(F.col("place") <= LAST_NAME, F.col("nr")).otherwise(upto)  # a last state is that of its prefix only
    per_k = counted.filter(F.col("nr") <= upto).select("name", "place", "n", *keys, F.explode(F.sequence(F.col("nr"), until)).alias("k"))
    sums = per_k.groupBy("k", "name", "place").agg(*[F.coalesce(F.sum(F.when(o, F.col("n"))), F.lit(0)).alias(f"n{f}") for f, o in enumerate(outside)])
    totals = rows.sparkSession.createDataFrame([(k, [out[f].cases(k) for f in range(parts)]) for k in range(1, k_max + 1)], "k int, cases array<long>")
    keep = [(F.col(f"n{f}") > 0) & (F.col(f"n{f}") >= F.lit(spec.min_share) * F.col("cases")[f]) for f in range(parts)]
    shares = sums.join(F.broadcast(totals), "k").select("k", "name", "place", F.array(*keep).alias("keep"))  # one row a prefix
    # at most 1 / min_share categories per (column, event, prefix, fold)
    for r in small_table(shares.filter(F.exists("keep", lambda x: x)), MOST_NAMES):
        for f, kept in enumerate(r["keep"]):
            if not kept:
                continue
            if r["place"] >= 0:
                out[f].numbers.setdefault(r["k"], []).append(r["place"])
            elif r["place"] >= LAST_NAME:
                out[f].categories.setdefault(r["k"], []).append(r["name"])
            else:
                out[f].lasts.setdefault(r["k"], []).append(LAST_NAME - 1 - r["place"])
    for s in out:
        for entries in [*s.categories.values(), *s.numbers.values(), *s.lasts.values()]:
            entries.sort()
    return out


LAST_NAME = -2  # place of a last state's name; its numbers have the places below


def _last_cells() -> list[Column]:
    """(nr, name, place) of the last states of every prefix."""
    named = F.flatten(F.transform("last_names", lambda xs, i: F.transform(xs, lambda x: F.struct((i + 1).cast("int").alias("nr"), x.alias("name"), F.lit(LAST_NAME).alias("place")))))
    numbers = F.flatten(F.transform("last_numbers", lambda xs, i: F.transform(xs, lambda x, j: F.when(x != 0, F.struct(
        (i + 1).cast("int").alias("nr"), F.lit("").alias("name"), (F.lit(LAST_NAME - 1) - j).cast("int").alias("place"))))))
    return [named, F.filter(numbers, lambda c: c.isNotNull())]


class PrefixSlicer(Model):
    """Case rows -> the vector of prefix k: kept categories, kept numbers, static values, kept last states. JVM functions only, sparse
    where that is smaller."""

    def __init__(self, spec, k: int, categories: list[str], numbers: list[int], variant: int = 0, outputCol: str = "features", extra: dict[str, int] | None = None,
                 lasts: list[int] = ()):
        super().__init__()
        self.spec, self.k, self.categories, self.numbers, self.lasts = spec, k, categories, numbers, list(lasts)
        self.variant, self.outputCol, self.extra = variant, outputCol, dict(extra or {})  # further vector columns and their sizes

    def feature_names(self) -> list[str]:
        stems = [stem for _, stem in encoders.event_numbers(self.spec)]
        placed = [stems[i % len(stems)].replace("{n}", str(i // len(stems) + 1)) for i in self.numbers]
        return [*self.categories, *placed, *self.spec.static_cols, *[f"{self.spec.last_state_cols[i]}_last" for i in self.lasts]]

    def _numbers(self) -> Column:
        statics = F.col("statics")[self.variant]
        known = [F.when(statics[i]["at"] <= self.k, statics[i]["number"]).otherwise(0.0) for i in range(len(self.spec.static_cols))]
        last = [F.coalesce(F.get(F.get("last_numbers", F.lit(self.k - 1)), F.lit(i)), F.lit(0.0)) for i in self.lasts]
        entries = [F.get("numbers", F.lit(i)) for i in self.numbers] + known + last
        return array_to_vector(F.array(*entries) if entries else F.array().cast("array<double>"))

    def _transform(self, rows: DataFrame) -> DataFrame:
        tokens, counts, dense = f"_t_{self.outputCol}", f"_c_{self.outputCol}", f"_d_{self.outputCol}"
        out = rows.withColumn(dense, self._numbers())
        # sizes said beforehand: otherwise each prefix would ask the first row, and fail without one
        sizes = {dense: len(self.numbers) + len(self.spec.static_cols) + len(self.lasts), **self.extra}
        for column, size in sizes.items():
            out = VectorSizeHint(inputCol=column, size=size, handleInvalid="optimistic").transform(out)
        parts = list(sizes)
        if self.categories:
            sliced = F.slice("names", F.lit(1), F.get("ends", F.lit(self.k - 1)))
            if self.spec.last_state_cols:
                sliced = F.concat(sliced, F.get("last_names", F.lit(self.k - 1)))
            model = CountVectorizerModel.from_vocabulary(self.categories, inputCol=tokens, outputCol=counts)
            out = model.transform(out.withColumn(tokens, sliced)).drop(tokens)
            parts = [counts, *parts]
        return VectorAssembler(inputCols=parts, outputCol=self.outputCol).transform(out).drop(dense, counts)
