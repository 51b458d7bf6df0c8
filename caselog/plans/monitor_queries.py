"""First crossings of the confidence levels, and their counts and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import monitor
from caselog.plans.logs import CASES_SQL, CONF_SQL, SCORES_SQL, order_log, order_scores
from caselog.plans.registry import query

FIRED_SQL = f"""{SCORES_SQL}, {CASES_SQL}, {CONF_SQL}, fired as (
  select confidence, case_id, cast(min(event_nr) as integer) as nr_events from scores, confs where score >= confidence group by confidence, case_id),
decided as (select confidence, case_id, label, case_length, nr_events from cases cross join confs left join fired using (confidence, case_id))"""


def counted_sql(unit):
    size = "1" if unit == "case" else "case_length"
    return f"""{FIRED_SQL}, counted as (select confidence,
  count(*) filter (where nr_events is not null and label = 1) as tp, count(*) filter (where nr_events is not null and label = 0) as fp,
  cast(coalesce(sum({size}) filter (where nr_events is null and label = 0), 0) as bigint) as tn,
  cast(coalesce(sum({size}) filter (where nr_events is null and label = 1), 0) as bigint) as fn,
  count(*) filter (where label = 1) as positives, count(nr_events) as n_alerts, count(*) as n_cases,
  coalesce(avg(nr_events / case_length::double), 0) as earliness, coalesce(avg(nr_events), 0) as mean_nr_events
  from decided group by confidence)"""


RATES_SQL = """, rates as (select *, coalesce(tp / nullif(positives, 0)::double, 0) as recall,
  case when n_alerts > 0 then (tp + tn) / (tp + tn + fp + fn)::double else 0 end as accuracy,
  case when n_alerts > 0 then tp / (tp + fp)::double else 0 end as "precision",
  case when n_alerts > 0 then 2.0 * tp / (2 * tp + fp + fn)::double else 0 end as f1,
  case when n_alerts > 0 then coalesce(tn / nullif(tn + fp, 0)::double, 0) else 0 end as specificity,
  1 - n_alerts / n_cases::double as failure_rate from counted)
"""
LONG_SQL = " union all ".join(
    f"select confidence, '{m}' as metric, round(cast(\"{m}\" as double), 6) as value from rates" for m in monitor.METRIC_COLUMNS)


def decided(spark, sf):
    return monitor.decisions(order_scores(spark, sf), "case_id", "event_nr", monitor.CONFIDENCES)


@query("first_crossings", "MN-3 MN-5 JN-7", f"with {FIRED_SQL} select confidence, case_id, label, case_length, nr_events from decided where nr_events is not null")
def first_crossings(spark, sf):
    return monitor.alerts(decided(spark, sf))


@query("unfinished_cases", "MN-6", f"with {FIRED_SQL} select confidence, case_id, label, case_length from decided where nr_events is null")
def unfinished_cases(spark, sf):
    return monitor.unfinished(decided(spark, sf)).drop("nr_events")


@query("unfinished_cases_by_join", "MN-6 FI-3 ST-2", f"""
with {FIRED_SQL} select case_id, label from decided where nr_events is null and confidence = 0.6""")
def unfinished_cases_by_join(spark, sf):
    cases = order_log(spark, sf, parts=False).filter("event_nr = 1").select("case_id", "label")
    fired = monitor.alerts(monitor.decisions(order_scores(spark, sf), "case_id", "event_nr", [0.6]))
    return monitor.unfinished_by_join(cases, fired, "case_id")


@query("alerts_with_case_length", "JN-5", f"""
with {FIRED_SQL} select confidence, case_id, nr_events, round(nr_events / case_length::double, 6) as part_seen from decided where nr_events is not null and confidence >= 0.8""")
def alerts_with_case_length(spark, sf):
    fired = monitor.alerts(monitor.decisions(order_scores(spark, sf), "case_id", "event_nr", [0.8, 0.85, 0.9, 0.95], keep=["label"]))
    lengths = order_log(spark, sf, parts=False).filter("event_nr = 1").select("case_id", "case_length")
    return fired.join(lengths, "case_id").select(
        "confidence", "case_id", "nr_events", F.round(F.col("nr_events") / F.col("case_length"), 6).alias("part_seen"))


@query("alerts_with_case_length_all_levels", "JN-5", f"""
with {FIRED_SQL} select confidence, case_id, nr_events, round(nr_events / case_length::double, 6) as part_seen from decided where nr_events is not null""")
def alerts_with_case_length_all_levels(spark, sf):
    fired = monitor.alerts(monitor.decisions(order_scores(spark, sf), "case_id", "event_nr", monitor.CONFIDENCES, keep=["label"]))
    lengths = order_log(spark, sf, parts=False).filter("event_nr = 1").select("case_id", "case_length")
    return fired.join(lengths, "case_id").select(
        "confidence", "case_id", "nr_events", F.round(F.col("nr_events") / F.col("case_length"), 6).alias("part_seen"))


@query("two_sided_alerts", "MN-4", f"""
with {SCORES_SQL}, {CONF_SQL}, p as (select *, least(score, 1.0) as p1 from scores),
h as (select confidence, case_id, case_length, label, event_nr, 1 as prediction from p, confs where p1 >= confidence
  union all select confidence, case_id, case_length, label, event_nr, 0 from p, confs where 1 - p1 >= confidence),
r as (select *, rank() over (partition by confidence, case_id order by event_nr) as rk from h)
select confidence, case_id, label, case_length, prediction, cast(event_nr as integer) as nr_events from r where rk = 1""")
def two_sided_alerts(spark, sf):
    p = F.least(F.col("score"), F.lit(1.0))
    scores = order_scores(spark, sf).withColumn("p1", p).withColumn("p0", 1.0 - p)
    return monitor.two_sided_alerts(scores, "case_id", "event_nr", monitor.CONFIDENCES, {1: "p1", 0: "p0"})


@query("two_sided_metrics", "MN-4 ME-1 ME-3", f"""
with {SCORES_SQL}, {CASES_SQL}, {CONF_SQL}, p as (select *, least(score, 1.0) as p1 from scores),
h as (select confidence, case_id, case_length, label, event_nr, 1 as prediction from p, confs where p1 >= confidence
  union all select confidence, case_id, case_length, label, event_nr, 0 from p, confs where 1 - p1 >= confidence),
r as (select *, rank() over (partition by confidence, case_id order by event_nr) as rk from h),
c as (select confidence, count(*) filter (where prediction = 1 and label = 1) as tp, count(*) filter (where prediction = 1 and label = 0) as fp,
  count(*) filter (where prediction = 0 and label = 0) as tn, count(*) filter (where prediction = 0 and label = 1) as fn,
  avg(event_nr / case_length::double) as earliness from r where rk = 1 group by confidence)
select confidence, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(tn, 0) as tn, coalesce(fn, 0) as fn, round(coalesce(tp, 0) / (select sum(label) from cases), 6) as recall,
  coalesce(round((tp + tn) / nullif(tp + tn + fp + fn, 0)::double, 6), 0) as accuracy, coalesce(round(tp / nullif(tp + fp, 0)::double, 6), 0) as "precision",
  round(coalesce(earliness, 0), 6) as earliness from confs left join c using (confidence)""")
def two_sided_metrics(spark, sf):
    p = F.least(F.col("score"), F.lit(1.0))
    scores = order_scores(spark, sf).withColumn("p1", p).withColumn("p0", 1.0 - p)
    fired = monitor.two_sided_alerts(scores, "case_id", "event_nr", monitor.CONFIDENCES, {1: "p1", 0: "p0"})
    cases = order_log(spark, sf, parts=False).filter("event_nr = 1")
    m = monitor.evaluate_two_sided(fired, cases, 1, confidences=monitor.CONFIDENCES)
    return m.select("confidence", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("recall", "accuracy", "precision", "earliness")])


@query("alert_counts_by_case", "ME-1 ME-2", f"with {counted_sql('case')} select confidence, tp, fp, tn, fn, positives, n_alerts, n_cases from counted")
def alert_counts_by_case(spark, sf):
    return monitor.evaluate(decided(spark, sf), 1).select("confidence", "tp", "fp", "tn", "fn", "positives", "n_alerts", "n_cases")


@query("alert_counts_by_event", "ME-1 ME-2", f"with {counted_sql('event')} select confidence, tp, fp, tn, fn, positives, n_alerts, n_cases from counted")
def alert_counts_by_event(spark, sf):
    return monitor.evaluate(decided(spark, sf), 1, unit="event").select("confidence", "tp", "fp", "tn", "fn", "positives", "n_alerts", "n_cases")


@query("alert_metrics_by_case", "MN-7 ME-1 ME-2 ME-3 ME-4 ME-5 ME-6 ME-12 IO-5", f"with {counted_sql('case')}{RATES_SQL}{LONG_SQL}")
def alert_metrics_by_case(spark, sf):
    return monitor.long_metrics(monitor.evaluate(decided(spark, sf), 1)).withColumn("value", F.round("value", 6))


@query("alert_metrics_by_event", "MN-7 ME-2 ME-3 ME-4", f"with {counted_sql('event')}{RATES_SQL}{LONG_SQL}")
def alert_metrics_by_event(spark, sf):
    return monitor.long_metrics(monitor.evaluate(decided(spark, sf), 1, unit="event")).withColumn("value", F.round("value", 6))
