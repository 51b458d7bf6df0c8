"""Quality measures over (label, prediction, probability) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.operators.ranks import in_ranges


def roc_auc(df: DataFrame, score: str, positive: Column, by: list[str] = (), slices: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group; null where only one class occurs.

    Rows are first counted per distinct score. Scores are cut into sampled
    ranges, so they may crowd anywhere; pairs are counted inside each range,
    and pairs across ranges follow from the range totals. No task sees more
    than one range.
    """
    both = F.col("p").cast("double") * F.col("n").cast("double")
    return won_pairs(df, score, positive, by, slices).select(*by, F.try_divide(F.col("won"), both).alias("auc"))


def won_pairs(df: DataFrame, score: str, positive: Column, by: list[str] = (), slices: int | None = None) -> DataFrame:
    """Per group: pairs of a positive and a negative row that the positive's score wins (ties by half), positives ``p``, negatives ``n``."""
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    sliced = in_ranges(counts, [F.col(c) for c in (*by, score)], slices).withColumn("_s", F.shiftright("_at", 33))

    below = Window.partitionBy(*by, "_s").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2.0)
    per_slice = sliced.withColumn("_w", pairs).groupBy(*by, "_s").agg(
        F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))

    earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    total = per_slice.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    won = F.sum(F.col("_w") + F.col("_p").cast("double") * F.col("_before"))
    return total.groupBy(*by).agg(won.alias("won"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))


def hard_auc(df: DataFrame, label: str, prediction: str, positive) -> DataFrame:
    """AUC of hard labels: the mean of the two classes' hit rates."""
    y, yhat = F.col(label) == F.lit(positive), F.col(prediction) == F.lit(positive)
    tpr = F.try_divide(F.count_if(y & yhat).cast("double"), F.count_if(y).cast("double"))
    tnr = F.try_divide(F.count_if(~y & ~yhat).cast("double"), F.count_if(~y).cast("double"))
    return df.agg(((tpr + tnr) / 2.0).alias("auc"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str, digits: int | None = None) -> DataFrame:
    """precision, recall, f1 and support per class, then accuracy, macro and weighted averages.

    After the confusion counts everything happens on one row that holds the
    few classes as an array.
    """
    counts = confusion(df, label, prediction)
    y, p = F.col(label).cast("string"), F.col(prediction).cast("string")
    sides = F.array(
        F.struct(y.alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"),
                 F.when(y == p, F.col("n")).otherwise(0).alias("hit")),
        F.struct(p.alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"),
                 F.lit(0).cast("bigint").alias("hit")))
    sums = counts.select(F.inline(sides)).groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"),
                                                              F.sum("hit").alias("hit"))

    def rate(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    rows = sums.select(
        "class", rate(F.col("hit"), F.col("said")).alias("precision"), rate(F.col("hit"), F.col("support")).alias("recall"),
        rate(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support", "hit")
    parts = ["precision", "recall", "f1"]
    n = F.sum("support")
    one = rows.agg(
        F.collect_list(F.struct("class", *parts, F.col("support").cast("bigint").alias("support"))).alias("rows"),
        n.alias("n"), (F.sum("hit") / n).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in parts],
        *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"w_{c}") for c in parts])

    def line(name, cols):
        return F.struct(F.lit(name).alias("class"), *[c.alias(q) for c, q in zip(cols, parts)], F.col("n").alias("support"))

    extra = F.array(line("accuracy", [F.col("acc")] * 3), line("macro avg", [F.col(f"m_{c}") for c in parts]),
                    line("weighted avg", [F.col(f"w_{c}") for c in parts]))
    report = one.select(F.inline(F.concat("rows", extra)))
    if digits is not None:
        report = report.select("class", *[F.round(c, digits).alias(c) for c in parts], F.col("support").cast("int").alias("support"))
    return report


def _bands(df: DataFrame, label: str, p_pos: str, levels: list[float]) -> DataFrame:
    """Rows with their ``band``: how many of the ascending levels the larger probability reaches, negative where it is label 0's.

    Bands ascend with the probability, and a level keeps whole bands: what a level needs is a sum over at most 2 * levels + 1
    rows, so the rows are counted once, whatever the number of levels.
    """
    p = F.col(p_pos)
    reached = F.size(F.filter(F.array(*[F.lit(float(c)) for c in levels]), lambda c: c <= F.greatest(p, 1.0 - p)))
    return df.select(F.col(label).alias("y"), p.alias("p"), F.when(p < 1.0 - p, -reached).otherwise(reached).alias("band"))


def _kept_bands(bands: DataFrame, levels: list[float], columns: list[str]) -> DataFrame:
    """(confidence, kept, all): the bands that each level keeps and all of them, in ascending order, as arrays; levels that keep none are left out."""
    one = bands.agg(F.array_sort(F.collect_list(F.struct("band", *columns))).alias("all"))  # one row of a few bands

    def beyond(i: int) -> Column:
        return F.filter("all", lambda b: F.abs(b["band"]) > i)

    cells = [F.struct(F.lit(float(c)).alias("confidence"), beyond(i).alias("kept")) for i, c in enumerate(levels)]
    return one.select("all", F.inline(F.array(*cells))).filter(F.size("kept") > 0)


def _sum(cells: Column, of) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda a, b: a + of(b).cast("double"))


def coverage_curve(df: DataFrame, label: str, p_pos: str, confidences: list[float]) -> DataFrame:
    """Per level: accuracy, AUC and share of the rows whose larger probability reaches it.

    Binary; ``p_pos`` is the probability of label 1. Levels no row reaches are left out. Pairs inside a band are counted once; pairs
    of bands follow from the bands' sums, since every score of a higher band is larger.
    """
    levels = sorted(set(confidences))
    rows = _bands(df, label, p_pos, levels)
    said = F.when(F.col("p") > 1.0 - F.col("p"), 1).otherwise(0)
    counts = rows.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.count("y").alias("known"), F.count_if(F.col("y") == said).alias("hits"))
    bands = counts.join(won_pairs(rows.filter("band <> 0"), "p", F.col("y") == 1, ["band"]), "band", "left")  # a row per band
    wide = _kept_bands(bands, levels, ["rows", "known", "hits", "won", "p", "n"])
    start = F.struct(F.lit(0.0).alias("won"), F.lit(0.0).alias("below"))
    pairs = F.aggregate("kept", start, lambda a, b: F.struct((a["won"] + b["won"] + b["p"] * a["below"]).alias("won"), (a["below"] + b["n"]).alias("below")))
    positives, negatives = _sum(F.col("kept"), lambda b: b["p"]), _sum(F.col("kept"), lambda b: b["n"])
    return wide.select(
        "confidence", F.try_divide(_sum(F.col("kept"), lambda b: b["hits"]), _sum(F.col("kept"), lambda b: b["known"])).alias("accuracy"),
        F.try_divide(pairs["won"], positives * negatives).alias("auc"),
        (_sum(F.col("kept"), lambda b: b["rows"]) / _sum(F.col("all"), lambda b: b["rows"])).alias("coverage"))


def detailed_metrics(df: DataFrame, label: str, p_pos: str, confidences: list[float]) -> DataFrame:
    """Eleven measures per level in long form, over rows whose larger probability reaches it."""
    levels = sorted(set(confidences))
    y, said = F.col("y") == 1, F.col("p") > 1.0 - F.col("p")
    bands = _bands(df, label, p_pos, levels).groupBy("band").agg(
        F.count_if(~y & ~said).alias("tn"), F.count_if(y & said).alias("tp"),
        F.count_if(y & ~said).alias("fn"), F.count_if(~y & said).alias("fp"))
    names = ["tn", "tp", "fn", "fp"]
    kept = _kept_bands(bands, levels, names)
    c = kept.select("confidence", *[_sum(F.col("kept"), lambda b: b[x]).alias(x) for x in names])  # noqa: B023
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))

    def rate(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    wide = c.withColumns({
        "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp),
        "fscore": rate(2.0 * tp, 2.0 * tp + fp + fn), "accuracy": rate(tp + tn, tp + tn + fp + fn),
        "failure_rate": 1.0 - rate(tp + tn, tp + tn + fp + fn), "earliness": 5.0 * (1.0 - F.col("confidence"))})
    from caselog.operators.monitor import long_metrics

    return long_metrics(wide, ["confidence"], ["tn", "tp", "fn", "failure_rate", "fscore", "precision", "fp", "accuracy",
                                               "earliness", "specificity", "recall"])
