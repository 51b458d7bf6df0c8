"""Splits, folds, samples and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import split
from caselog.operators.events import first_known
from caselog.plans.logs import LOG_SQL, order_log, table
from caselog.plans.registry import query
from caselog.session import durable

CASES = LOG_SQL + ", cases as (select case_id, max(label) as label from log group by case_id)"


def labelled_cases(spark, sf):
    """One row per case. Kept, since ranking reads it twice and the log behind it is far larger."""
    return durable(order_log(spark, sf, parts=False).groupBy("case_id").agg(first_known("label", "event_nr").alias("label")))


def md5_order(seed, key="case_id"):
    return f"md5(cast({key} as varchar) || '_{seed}')"


@query("case_split", "SP-1", f"""
with {CASES} select case_id, label, row_number() over (order by {md5_order(22)}, case_id) <= floor(0.8 * count(*) over ()) as is_train from cases""")
def case_split(spark, sf):
    return split.split_exact(labelled_cases(spark, sf), "case_id", 0.8)


@query("case_split_threshold", "SP-1", f"""
with {LOG_SQL} select case_id, event_nr::integer as event_nr, cast('0x' || substr({md5_order(22)}, 1, 8) as bigint) / 4294967296.0 < 0.8 as is_train from log""")
def case_split_threshold(spark, sf):
    return split.split_threshold(order_log(spark, sf, parts=False), "case_id", 0.8).select("case_id", "event_nr", "is_train")


@query("stratified_split", "SP-2", f"""
with {CASES} select case_id, label, row_number() over (partition by label order by {md5_order(42)}, case_id)
  <= floor(0.7 * count(*) over (partition by label)) as is_train from cases""")
def stratified_split(spark, sf):
    return split.split_exact(labelled_cases(spark, sf), "case_id", 0.7, 42, "label")


@query("row_split", "SP-3 FI-4", f"""
select event_id, cast('0x' || substr({md5_order(42, 'event_id')}, 1, 8) as bigint) / 4294967296.0 < 0.8 as is_train from events""")
def row_split(spark, sf):
    return split.split_threshold(table(spark, sf, "events"), "event_id", 0.8, 42).select("event_id", "is_train")


@query("stratified_folds", "SP-4 WI-4", f"""
with {CASES} select case_id, label, cast((row_number() over (partition by label order by {md5_order(22)}, case_id) - 1) % 5 as integer) as fold from cases""")
def stratified_folds(spark, sf):
    return split.stratified_folds(labelled_cases(spark, sf), "case_id", "label")


@query("leave_one_out_folds", "SP-5", f"""
select event_id, row_number() over (order by {md5_order(22, 'event_id')}, event_id) - 1 as fold from events""")
def leave_one_out_folds(spark, sf):
    return split.row_folds(table(spark, sf, "events").select("event_id"), "event_id")


@query("sampled_cases", "SP-6", f"""
with c as (select distinct l_orderkey as case_id from lineitem), s as (select case_id from c order by {md5_order(22)}, case_id limit 500)
select l_orderkey, l_partkey, l_quantity from lineitem where l_orderkey in (select case_id from s)""")
def sampled_cases(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(split.sample_keys(lines, "l_orderkey", 500), "l_orderkey", "left_semi")


@query("sampled_rows", "SP-7", f"select event_id, value from events order by {md5_order(42, 'event_id')}, event_id limit 2000")
def sampled_rows(spark, sf):
    return split.sample_rows(table(spark, sf, "events").select("event_id", "value"), "event_id", 2000)


@query("balanced_classes", "SP-8 AG-14", f"""
with {CASES}, r as (select *, row_number() over (partition by label order by {md5_order(42)}, case_id) as rk from cases)
select case_id, label from r where rk <= (select min(n) from (select count(*) as n from cases group by label))""")
def balanced_classes(spark, sf):
    return split.balance_down(labelled_cases(spark, sf), "case_id", "label")


@query("oversampled_minority", "SP-9", f"""
with {CASES}, n as (select count(*) filter (where label = 1) as mi, count(*) filter (where label = 0) as ma from cases),
m as (select *, row_number() over (order by {md5_order(22)}, case_id) - 1 as rk from cases where label = 1),
d as (select unnest(range(ma - mi)) as i, mi from n),
e as (select cast('0x' || substr({md5_order(22, 'i')}, 1, 15) as bigint) % mi as rk from d)
select case_id, label, count(*) as copies from (select case_id, label from cases union all select case_id, label from e join m using (rk)) group by all""")
def oversampled_minority(spark, sf):
    more = split.oversample(labelled_cases(spark, sf), "case_id", "label", 1)
    return more.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@query("shuffled_rows", "SP-10", f"select event_id, {md5_order(42, 'event_id')} as key from events")
def shuffled_rows(spark, sf):
    from caselog.functions.hashing import shuffle_key

    return split.shuffle_rows(table(spark, sf, "events").select("event_id"), "event_id").withColumn("key", shuffle_key("event_id", 42))
