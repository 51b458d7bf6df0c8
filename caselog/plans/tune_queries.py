"""Grids, fold means, best parameters and summaries over alert metrics per fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import monitor, split, tune
from caselog.plans.logs import CONF_SQL, SCORES_SQL, order_scores, table
from caselog.plans.registry import query

# Fold metrics of a rule score read with three thresholds of the running mean.
FOLDED_SQL = f"""{SCORES_SQL}, cases as (select case_id, max(label) as label from log group by case_id),
folds as (select case_id, (row_number() over (partition by label order by md5(cast(case_id as varchar) || '_22'), case_id) - 1) % 5 + 1 as part from cases),
{CONF_SQL}, g as (select unnest(['90', '100', '110']) as selected),
fired as (select selected, confidence, case_id from scores, confs, g where score * cast(selected as double) / 100.0 >= confidence group by all),
cnt as (select selected, confidence, cast(part as varchar) as part, count(*) filter (where f.case_id is not null and label = 1) as tp,
    count(*) filter (where f.case_id is not null and label = 0) as fp, count(*) filter (where f.case_id is null and label = 1) as fn
  from cases join folds using (case_id) cross join confs cross join g left join fired f using (selected, confidence, case_id) group by all),
metrics as (select confidence, selected, 'rf' as cls, part, 'f1' as metric, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as value from cnt
  union all select confidence, selected, 'rf', part, 'recall', coalesce(tp / nullif(tp + fn, 0)::double, 0) from cnt)"""
SETTINGS = ["90", "100", "110"]


def fold_metrics(spark, sf):
    """f1 and recall per (confidence, setting, fold); the settings scale the score."""
    scores = order_scores(spark, sf)
    cases = scores.groupBy("case_id").agg(F.max("label").alias("label"))
    folds = split.stratified_folds(cases, "case_id", "label").select("case_id", (F.col("fold") + 1).cast("string").alias("part"))
    scaled = scores.withColumns({f"p{x}": F.col("score") * F.lit(float(x)) / 100.0 for x in SETTINGS})
    decided = monitor.decisions_by_setting(scaled, "case_id", "event_nr", monitor.CONFIDENCES, {x: f"p{x}" for x in SETTINGS}, keep=["label"])
    fired, pos = F.col("nr_events").isNotNull(), F.col("label") == 1
    counts = decided.join(folds, "case_id").groupBy(F.col("setting").alias("selected"), "confidence", "part").agg(
        F.count_if(fired & pos).alias("tp"), F.count_if(fired & ~pos).alias("fp"), F.count_if(~fired & pos).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    wide = counts.select(
        "confidence", "selected", F.lit("rf").alias("cls"), "part",
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"))
    return monitor.long_metrics(wide, ["confidence", "selected", "cls", "part"], ["f1", "recall"])


@query("parameter_grid", "TU-1", """
select cls, cast(ngram as integer) as ngram, tfidf, size from (select distinct o_orderstatus as cls from orders), (select unnest([1, 2, 3]) as ngram),
(select unnest(['tfidf', 'no-tfidf']) as tfidf), (select distinct p_size as size from part)""")
def parameter_grid(spark, sf):
    classes = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cls")).distinct()
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("size")).distinct()
    fixed = tune.grid(spark, {"ngram": [1, 2, 3], "tfidf": ["tfidf", "no-tfidf"]}).withColumn("ngram", F.col("ngram").cast("int"))
    return classes.crossJoin(fixed).crossJoin(sizes)


@query("fold_metrics", "TU-2", f"with {FOLDED_SQL} select confidence, selected, cls, part, metric, round(value, 6) as value from metrics")
def fold_metric_rows(spark, sf):
    return fold_metrics(spark, sf).withColumn("value", F.round("value", 6))


@query("fold_means", "AG-10", f"with {FOLDED_SQL} select confidence, selected, cls, metric, round(avg(value), 6) as value from metrics group by all")
def fold_means(spark, sf):
    return tune.fold_means(fold_metrics(spark, sf)).withColumn("value", F.round("value", 6))


BEST_SQL = FOLDED_SQL + """, means as (select confidence, selected, cls, metric, round(avg(value), 9) as value from metrics where metric = 'f1' group by all),
best as (select *, row_number() over (partition by confidence, cls order by value desc, selected) as rk from means)"""


@query("best_parameters", "TU-3 AG-11", f"with {BEST_SQL} select confidence, cls, selected, metric, round(value, 6) as value from best where rk = 1")
def best_parameters(spark, sf):
    means = tune.fold_means(fold_metrics(spark, sf)).withColumn("value", F.round("value", 9))
    return tune.best_parameters(means, ["selected"]).withColumn("value", F.round("value", 6))


@query("parameter_lookup", "JN-6 FI-6 TU-4", f"""
with {BEST_SQL} select m.confidence, m.selected, m.part, round(m.value, 6) as value from metrics m join best b using (confidence, cls, selected) where rk = 1 and m.metric = 'recall'""")
def parameter_lookup(spark, sf):
    metrics = fold_metrics(spark, sf)
    best = tune.best_parameters(tune.fold_means(metrics).withColumn("value", F.round("value", 9)), ["selected"]).select("confidence", "cls", "selected")
    return metrics.filter("metric = 'recall'").join(best, ["confidence", "cls", "selected"]).select(
        "confidence", "selected", "part", F.round("value", 6).alias("value"))


@query("result_summary", "TU-5", f"""
with {FOLDED_SQL} select selected, part, confidence, round(max(value) filter (where metric = 'f1'), 6) as f1, round(max(value) filter (where metric = 'recall'), 6) as recall,
  0.0::double as precision from metrics group by all""")
def result_summary(spark, sf):
    wide = tune.summary(fold_metrics(spark, sf), ["selected", "part", "confidence"], ["f1", "recall", "precision"])
    return wide.withColumn("f1", F.round("f1", 6)).withColumn("recall", F.round("recall", 6))


@query("run_counts", "TU-6", f"with {FOLDED_SQL} select count(distinct selected) as n_configs, count(distinct selected || '_part' || part) as n_files from metrics")
def run_counts(spark, sf):
    named = fold_metrics(spark, sf).withColumn("file", F.concat("selected", F.lit("_part"), "part"))
    return tune.count_runs(named, "selected", "file")
