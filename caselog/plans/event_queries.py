"""Joins, aggregates, windows, sorts and set operations over logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import events as E
from caselog.plans.logs import LOG_SQL, USER_SQL, order_events, order_log, table, user_log
from caselog.plans.registry import query


@query("numbered_events", "WI-1 AG-5 SO-1", """
select l_orderkey as case_id, l_shipdate::varchar as ts, l_partkey, l_suppkey, l_extendedprice,
  cast(row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_quantity, l_discount, l_tax) as integer) as event_nr, count(*) over (partition by l_orderkey) as case_length from lineitem""")
def numbered_events(spark, sf):
    return order_events(spark, sf).select(
        "case_id", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ts"), "l_partkey", "l_suppkey", "l_extendedprice",
        "event_nr", "case_length")


@query("numbered_by_source_order", "WI-2", """
select event_id, cast(row_number() over (partition by user_id order by event_id) as integer) as event_nr from events""")
def numbered_by_source_order(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    numbered = E.number_events(events, "user_id", [F.col("event_id")], F.floor(F.col("event_id") / 1000), length=None)
    return numbered.select("event_id", "event_nr")


@query("user_day_log", "WI-1 WI-3 AG-6", f"with {USER_SQL} select case_id, event_id, cast(event_nr as integer) as event_nr, case_length, act, cast(label as integer) as label from ulog")
def user_day_log(spark, sf):
    return user_log(spark, sf).select("case_id", "event_id", "event_nr", "case_length", "act", "label")


@query("case_left_join", "JN-1 WI-3", """
with n as (select l_orderkey, sum(l_quantity) as qty from lineitem group by l_orderkey)
select o_orderkey, o_orderstatus, qty from orders left join n on o_orderkey = l_orderkey""")
def case_left_join(spark, sf):
    qty = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    return E.with_case_value(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", qty)


@query("feature_blocks_joined", "JN-2", f"""
with {LOG_SQL} select case_id, coalesce(max(case when event_nr = 1 then l_quantity end), 0) as l_quantity_event1,
  max_by(txt, event_nr) as txt from log where event_nr <= 2 group by case_id""")
def feature_blocks_joined(spark, sf):
    from caselog.operators import encode

    log = order_log(spark, sf)
    numbers = encode.wide_numbers(log, "case_id", "event_nr", 1, ["l_quantity"])
    return numbers.join(encode.last_state_block(log, "case_id", "event_nr", ["txt"], 2), "case_id")


@query("first_known_values", "AG-1", f"""
with {USER_SQL} select case_id, min_by(act, event_nr) filter (where act <> 'view') as act,
  min_by(value, event_nr) filter (where act = 'click') as value from ulog group by case_id""")
def first_known_values(spark, sf):
    log = user_log(spark, sf).withColumn("value", F.when(F.col("act") == "click", F.col("value"))).withColumn(
        "act", F.when(F.col("act") != "view", F.col("act")))
    return E.case_table(log, "case_id", "event_nr", ["act", "value"])


@query("last_known_values", "AG-2", f"""
with {USER_SQL} select case_id, max_by(act, event_nr) filter (where act <> 'view') as act,
  max_by(value, event_nr) filter (where act = 'click') as value from ulog group by case_id""")
def last_known_values(spark, sf):
    log = user_log(spark, sf).withColumn("value", F.when(F.col("act") == "click", F.col("value"))).withColumn(
        "act", F.when(F.col("act") != "view", F.col("act")))
    return E.last_state(log, "case_id", "event_nr", ["act", "value"])


@query("case_counts", "AG-3 AG-8 AG-15", f"""
with {LOG_SQL} select count(distinct case_id) as n_cases, count(*) as n_events, round(count(*) / count(distinct case_id)::double, 6) as mean_length,
  cast(max(event_nr) as integer) as max_events from log""")
def case_counts(spark, sf):
    per_case = order_events(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_nr").alias("last"))
    return per_case.agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n").alias("n_events"),
                        F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("mean_length"), F.max("last").alias("max_events"))


@query("value_counts", "AG-4", """
select p_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from part group by p_type""")
def value_counts(spark, sf):
    return E.value_counts(table(spark, sf, "part"), "p_type").withColumn("share", F.round("share", 6))


@query("label_shares", "AG-4 AG-1", f"""
with {LOG_SQL}, c as (select case_id, max(label) as label from log group by case_id)
select label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from c group by label""")
def label_shares(spark, sf):
    cases = E.case_table(order_log(spark, sf, parts=False), "case_id", "event_nr", ["label"])
    return E.value_counts(cases, "label").withColumn("share", F.round("share", 6))


@query("case_outcomes", "AG-6 UD-2", """
select l_orderkey, case when bool_or(l_returnflag = 'R') then 'successful' else 'unsuccessful' end as label from lineitem group by l_orderkey""")
def case_outcomes(spark, sf):
    return E.case_outcome(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("case_length_summary", "AG-7", f"""
with {LOG_SQL}, c as (select case_id, max(event_nr)::double as x from log group by case_id)
select count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, min(x) as "min", quantile_cont(x, 0.25) as q25,
  quantile_cont(x, 0.5) as q50, quantile_cont(x, 0.75) as q75, max(x) as "max" from c""")
def case_length_summary(spark, sf):
    d = E.describe_lengths(order_events(spark, sf), "case_id", "case_length")
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("table_profile", "AG-9 AG-16", """
with t as (select event_id, case when event_type = 'error' then null else event_type end as act, case when value < 10 then null else value end as value from events)
select 'event_id' as column_name, 'bigint' as data_type, count(*) as n_rows, count(*) - count(event_id) as n_nulls from t
union all select 'act', 'string', count(*), count(*) - count(act) from t
union all select 'value', 'double', count(*), count(*) - count(value) from t""")
def table_profile(spark, sf):
    return E.profile(table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("act"),
        F.when(F.col("value") >= 10, F.col("value")).alias("value")))


@query("distinct_values", "AG-13", "select distinct p_brand, p_type from part")
def distinct_values(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("smallest_class", "AG-14", "select min(n) as n from (select o_orderstatus, count(*) as n from orders group by o_orderstatus)")
def smallest_class(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))


@query("first_rows", "SO-1 SO-2", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def first_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("event_number_counts", "SO-5 AG-4", f"with {LOG_SQL} select cast(event_nr as integer) as event_nr, count(*) as n from log group by event_nr")
def event_number_counts(spark, sf):
    return order_events(spark, sf).groupBy("event_nr").agg(F.count(F.lit(1)).alias("n")).orderBy("event_nr")


@query("united_rows", "ST-1", """
select o_orderkey as id, o_totalprice as amount, cast(null as varchar) as name from orders
union all select p_partkey, p_retailprice, p_name from part""")
def united_rows(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("amount"), F.col("p_name").alias("name"))
    return orders.unionByName(parts, allowMissingColumns=True)


@query("case_difference", "ST-2", """
select o_orderkey as case_id from orders except select l_orderkey from lineitem where l_returnflag = 'R'""")
def case_difference(spark, sf):
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id")).join(returned, "case_id", "left_anti").distinct()


@query("duplicate_event_keys", "FI-7", """
select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by l_orderkey, l_linenumber having count(*) > 1""")
def duplicate_event_keys(spark, sf):
    return E.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("first_of_duplicates", "JN-1", """
select l_orderkey, l_linenumber, min_by(l_partkey, (l_shipdate, l_partkey, l_suppkey)) as l_partkey from lineitem group by l_orderkey, l_linenumber""")
def first_of_duplicates(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return E.keep_first_event(lines, "l_orderkey", "l_linenumber", ["l_shipdate", "l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey")
