"""Quality measures of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import metrics, monitor
from caselog.plans.logs import CONF_SQL, DOCS_SQL, SCORES_SQL, labelled_documents, order_scores
from caselog.plans.registry import query

AUC = """(sum(rk) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
  / (count(*) filter (where y = 1) * count(*) filter (where y = 0))"""
PROB_SQL = SCORES_SQL + ", prob as (select case_id, event_nr, label as y, least(score, 1.0) as p from scores)"


def probabilities(spark, sf):
    return order_scores(spark, sf).select("case_id", "event_nr", F.col("label").alias("y"), F.least(F.col("score"), F.lit(1.0)).alias("p"))


@query("auc_of_scores", "ME-7", f"""
with {PROB_SQL}, r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from prob)
select round({AUC}, 9) as auc from r""")
def auc_of_scores(spark, sf):
    return metrics.roc_auc(probabilities(spark, sf), "p", F.col("y") == 1).select(F.round("auc", 9).alias("auc"))


@query("auc_per_prefix", "ME-7", f"""
with {PROB_SQL}, r as (select event_nr, y, rank() over (partition by event_nr order by p) + (count(*) over (partition by event_nr, p) - 1) / 2.0 as rk from prob)
select cast(event_nr as integer) as event_nr, case when count(distinct y) > 1 then round({AUC}, 9) end as auc from r group by event_nr""")
def auc_per_prefix(spark, sf):
    return metrics.roc_auc(probabilities(spark, sf), "p", F.col("y") == 1, ["event_nr"]).withColumn("auc", F.round("auc", 9))


@query("auc_of_lengths", "ME-7", f"""
with {DOCS_SQL}, r as (select quality as y, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as rk from docs)
select round({AUC}, 9) as auc from r""")
def auc_of_lengths(spark, sf):
    return metrics.roc_auc(labelled_documents(spark, sf), "n_chars", F.col("quality") == 1).select(F.round("auc", 9).alias("auc"))


@query("auc_of_hard_labels", "ME-8", f"""
with {PROB_SQL}, h as (select y, case when p > 0.5 then 1 else 0 end as yhat from prob)
select round((sum(y * yhat) / sum(y)::double + sum((1 - y) * (1 - yhat)) / sum(1 - y)::double) / 2, 9) as auc from h""")
def auc_of_hard_labels(spark, sf):
    rows = probabilities(spark, sf).withColumn("yhat", (F.col("p") > 0.5).cast("int"))
    return metrics.hard_auc(rows, "y", "yhat", 1).select(F.round("auc", 9).alias("auc"))


@query("accuracy_of_hard_labels", "ME-9", f"""
with {PROB_SQL} select round(avg(cast(y = case when p > 0.5 then 1 else 0 end as integer)), 9) as accuracy from prob""")
def accuracy_of_hard_labels(spark, sf):
    rows = probabilities(spark, sf).withColumn("yhat", (F.col("p") > 0.5).cast("int"))
    return metrics.accuracy(rows, "y", "yhat").select(F.round("accuracy", 9).alias("accuracy"))


@query("confusion_matrix", "ME-1 ME-10", f"""
with {PROB_SQL} select y, case when p > 0.5 then 1 else 0 end as yhat, count(*) as n from prob group by all""")
def confusion_matrix(spark, sf):
    return metrics.confusion(probabilities(spark, sf).withColumn("yhat", (F.col("p") > 0.5).cast("int")), "y", "yhat")


@query("classification_report", "ME-10 PR-20", f"""
with {PROB_SQL}, h as (select y, case when p > 0.5 then 1 else 0 end as yhat from prob),
c as (select cls, count(*) filter (where y = cls) as support, count(*) filter (where yhat = cls) as said, count(*) filter (where y = cls and yhat = cls) as hit
  from h, (select unnest([0, 1]) as cls) group by cls),
r as (select cast(cls as varchar) as "class", hit / said::double as p, hit / support::double as r, 2.0 * hit / (said + support)::double as f, support, hit from c)
select "class", round(p, 3) as "precision", round(r, 3) as recall, round(f, 3) as f1, cast(support as integer) as support from r
union all select 'accuracy', round(sum(hit) / sum(support)::double, 3), round(sum(hit) / sum(support)::double, 3), round(sum(hit) / sum(support)::double, 3), cast(sum(support) as integer) from r
union all select 'macro avg', round(avg(p), 3), round(avg(r), 3), round(avg(f), 3), cast(sum(support) as integer) from r
union all select 'weighted avg', round(sum(p * support) / sum(support), 3), round(sum(r * support) / sum(support), 3), round(sum(f * support) / sum(support), 3), cast(sum(support) as integer) from r""")
def classification_report(spark, sf):
    rows = probabilities(spark, sf).withColumn("yhat", (F.col("p") > 0.5).cast("int"))
    return metrics.classification_report(rows, "y", "yhat", digits=3)


KEPT_SQL = PROB_SQL + f", {CONF_SQL}, kept as (select confidence, y, p, case when p > 1 - p then 1 else 0 end as yhat from prob, confs where greatest(p, 1 - p) >= confidence)"


@query("coverage_curve", "ME-11 FI-5", f"""
with {KEPT_SQL}, r as (select *, rank() over (partition by confidence order by p) + (count(*) over (partition by confidence, p) - 1) / 2.0 as rk from kept)
select confidence, round(avg(cast(y = yhat as integer)), 9) as accuracy, round({AUC}, 9) as auc,
  round(count(*) / (select count(*) from prob)::double, 9) as coverage from r group by confidence""")
def coverage_curve(spark, sf):
    curve = metrics.coverage_curve(probabilities(spark, sf), "y", "p", monitor.CONFIDENCES)
    return curve.select("confidence", *[F.round(c, 9).alias(c) for c in ("accuracy", "auc", "coverage")])


DETAIL = {"tn": "tn", "tp": "tp", "fn": "fn", "failure_rate": "1 - (tp + tn) / (tp + tn + fp + fn)::double", "fscore": "2.0 * tp / (2 * tp + fp + fn)::double",
          "precision": "tp / (tp + fp)::double", "fp": "fp", "accuracy": "(tp + tn) / (tp + tn + fp + fn)::double", "earliness": "5 * (1 - confidence)",
          "specificity": "tn / (tn + fp)::double", "recall": "tp / (tp + fn)::double"}


@query("detailed_metrics", "ME-12 ME-5 ME-6", f"""
with {KEPT_SQL}, c as (select confidence, sum((1 - y) * (1 - yhat)) as tn, sum(y * yhat) as tp, sum(y * (1 - yhat)) as fn, sum((1 - y) * yhat) as fp from kept group by confidence)
""" + " union all ".join(f"select confidence, '{m}' as metric, round(cast(coalesce({e}, 0) as double), 6) as value from c" for m, e in DETAIL.items()))
def detailed_metrics(spark, sf):
    return metrics.detailed_metrics(probabilities(spark, sf), "y", "p", monitor.CONFIDENCES).withColumn("value", F.round("value", 6))
