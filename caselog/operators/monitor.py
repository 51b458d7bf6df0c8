"""Prefix monitoring: the first prefix of each case that is sure enough.

Probabilities do not depend on the confidence level, so a case is scored
once and all levels are decided in one aggregate per case. Rows are not
multiplied by the levels before that aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Confidence levels of the experiments.
CONFIDENCES = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def decisions(scores: DataFrame, case: str, nr: str, confidences: list[float], probability: str = "score",
              keep: list[str] = ("label", "case_length")) -> DataFrame:
    """One row per case and level: the first prefix with probability >= level, or null.

    ``keep`` columns are constant per case.
    """
    firsts = [F.min(F.when(F.col(probability) >= c, F.col(nr))).alias(f"_a{i}") for i, c in enumerate(confidences)]
    per_case = scores.groupBy(case).agg(*[F.max(c).alias(c) for c in keep], *firsts)
    levels = F.array(*[F.struct(F.lit(float(c)).alias("confidence"), F.col(f"_a{i}").alias("nr_events"))
                       for i, c in enumerate(confidences)])
    return per_case.select(case, *keep, F.inline(levels))


def decisions_by_setting(scores: DataFrame, case: str, nr: str, confidences: list[float], settings: dict[str, str],
                         keep: list[str] = ("label", "case_length")) -> DataFrame:
    """``decisions`` for several scorings of the same prefixes at once, in the same single aggregate.

    ``settings`` maps a setting's name to its probability column.
    """
    pairs = [(s, p, c) for s, p in settings.items() for c in confidences]
    firsts = [F.min(F.when(F.col(p) >= c, F.col(nr))).alias(f"_a{i}") for i, (_, p, c) in enumerate(pairs)]
    per_case = scores.groupBy(case).agg(*[F.max(c).alias(c) for c in keep], *firsts)
    levels = F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(float(c)).alias("confidence"), F.col(f"_a{i}").alias("nr_events"))
                       for i, (s, _, c) in enumerate(pairs)])
    return per_case.select(case, *keep, F.inline(levels))


def alerts(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("nr_events").isNotNull())


def unfinished(decided: DataFrame) -> DataFrame:
    """Cases without an alert; one-sided monitoring predicts the negative class for them."""
    return decided.filter(F.col("nr_events").isNull())


def unfinished_by_join(cases: DataFrame, fired: DataFrame, case: str) -> DataFrame:
    """The same from stored alerts of one level: cases that are not among them."""
    return cases.join(fired, case, "left_anti")


def two_sided_alerts(scores: DataFrame, case: str, nr: str, confidences: list[float], classes: dict,
                     keep: list[str] = ("label", "case_length")) -> DataFrame:
    """First prefix where any class is sure enough; classes that tie there all give a row.

    ``classes`` maps each class to its probability column.
    """
    names = list(classes)
    firsts = [F.min(F.when(F.col(classes[y]) >= c, F.col(nr))).alias(f"_a{i}_{j}")
              for i, c in enumerate(confidences) for j, y in enumerate(names)]
    per_case = scores.groupBy(case).agg(*[F.max(c).alias(c) for c in keep], *firsts)
    cells = []
    for i, c in enumerate(confidences):
        mine = [F.col(f"_a{i}_{j}") for j in range(len(names))]
        first = F.least(*mine) if len(mine) > 1 else mine[0]
        cells += [F.struct(F.lit(float(c)).alias("confidence"), F.lit(y).alias("prediction"),
                           F.when(mine[j] == first, first).alias("nr_events")) for j, y in enumerate(names)]
    return per_case.select(case, *keep, F.inline(F.array(*cells))).filter(F.col("nr_events").isNotNull())


def evaluate(decided: DataFrame, positive, unit: str = "case", max_events: int | None = None, rows: str = "case_length",
             failure: bool = False) -> DataFrame:
    """Counts and rates per level from one-sided decisions.

    unit="case" counts unfinished cases, unit="event" counts their event rows
    (column ``rows``). Recall is tp over positive cases. Everything is 0
    where there is nothing to divide, and all but recall is 0 without alerts.
    """
    pos = F.col("label") == F.lit(positive)
    fired = F.col("nr_events").isNotNull()
    size = F.lit(1) if unit == "case" else F.col(rows)
    span = F.col("case_length") if max_events is None else F.least("case_length", F.lit(max_events))
    counts = decided.groupBy("confidence").agg(
        F.count_if(fired & pos).alias("tp"),
        F.count_if(fired & ~pos).alias("fp"),
        F.sum(F.when(~fired & ~pos, size).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when(~fired & pos, size).otherwise(0)).cast("bigint").alias("fn"),
        F.count_if(pos).alias("positives"),
        F.count_if(fired).alias("n_alerts"),
        F.count(F.lit(1)).alias("n_cases"),
        F.coalesce(F.avg(F.when(fired, F.col("nr_events") / span)), F.lit(0.0)).alias("earliness"),
        F.coalesce(F.avg(F.when(fired, F.col("nr_events"))), F.lit(0.0)).alias("mean_nr_events"),
    )
    return with_rates(counts)


def evaluate_two_sided(fired: DataFrame, cases: DataFrame, positive, max_events: int | None = None, confidences: list[float] = ()) -> DataFrame:
    """Counts and rates per level from two-sided alerts; ``cases`` has one labelled row per case.

    Levels named in ``confidences`` have a row also where nothing was sure enough, with zeros.
    """
    pos = F.col("label") == F.lit(positive)
    said = F.col("prediction") == F.lit(positive)
    span = F.col("case_length") if max_events is None else F.least("case_length", F.lit(max_events))
    counts = fired.groupBy("confidence").agg(
        F.count_if(said & pos).alias("tp"), F.count_if(said & ~pos).alias("fp"),
        F.count_if(~said & ~pos).alias("tn"), F.count_if(~said & pos).alias("fn"),
        F.count(F.lit(1)).alias("n_alerts"), F.avg(F.col("nr_events") / span).alias("earliness"),
        F.avg("nr_events").alias("mean_nr_events"))
    if confidences:
        levels = fired.sparkSession.createDataFrame([(float(c),) for c in confidences], "confidence double")
        counts = levels.join(counts, "confidence", "left").na.fill(0)
    totals = cases.agg(F.count_if(pos).alias("positives"), F.count(F.lit(1)).alias("n_cases"))
    return with_rates(counts.crossJoin(F.broadcast(totals)))  # one row


def with_rates(counts: DataFrame) -> DataFrame:
    """recall, accuracy, precision, f1, specificity and failure rate from counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def rate(a, b):
        return F.when(F.col("n_alerts") > 0, F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))).otherwise(0.0)

    return counts.withColumns({
        "recall": F.coalesce(F.try_divide(tp.cast("double"), F.col("positives").cast("double")), F.lit(0.0)),
        "accuracy": rate(tp + tn, tp + tn + fp + fn),
        "precision": rate(tp, tp + fp),
        "f1": rate(2 * tp, 2 * tp + fp + fn),
        "specificity": rate(tn, tn + fp),
        "failure_rate": 1.0 - F.col("n_alerts") / F.col("n_cases"),
    })


METRIC_COLUMNS = ["tp", "fp", "tn", "fn", "recall", "accuracy", "precision", "f1", "specificity", "earliness",
                  "mean_nr_events", "failure_rate"]


def long_metrics(wide: DataFrame, keys: list[str] = ("confidence",), columns: list[str] = METRIC_COLUMNS) -> DataFrame:
    """(keys, metric, value) rows from one column per metric."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return wide.select(*keys, F.inline(cells))
