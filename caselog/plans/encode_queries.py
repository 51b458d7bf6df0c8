"""Prefix encoding of the order log."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import clean, encode, features, split
from caselog.plans.logs import LOG_SQL, order_log, table
from caselog.plans.registry import query

K = 3
CAT_SQL = LOG_SQL + f""", ccells as (
  select case_id, event_nr, 'cat' as source, cat as value from log where event_nr <= {K}
  union all select case_id, event_nr, '', act from log where event_nr <= {K}),
named as (select *, case when source = '' then 'event' || event_nr || '_' || value else source || '_event' || event_nr || '_' || value end as feature from ccells)"""
CELLS_SQL = CAT_SQL + f""", cells as (select case_id, event_nr, feature, 1.0::double as number from named
  union all select case_id, event_nr, 'l_quantity_event' || event_nr, l_quantity from log where event_nr <= {K} and l_quantity <> 0
  union all select case_id, event_nr, 'l_extendedprice_event' || event_nr, l_extendedprice from log where event_nr <= {K} and l_extendedprice <> 0)"""


def order_cells(spark, sf, k=K):
    return encode.all_cells(order_log(spark, sf), "case_id", "event_nr", k, "act", ["cat"], ["l_quantity", "l_extendedprice"])


@query("rare_category_groups", "EN-1", """
with b as (select p_partkey, p_name || case when p_partkey % 3 = 0 then ' for Business' when p_partkey % 3 = 1 then ' boat TAX' else '' end as goal from part),
f as (select l_orderkey as case_id, min_by(goal, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) as value from lineitem join b on l_partkey = p_partkey group by l_orderkey),
c as (select value, count(*) as n from f group by value)
select value, case when lower(value) like '%business%' then 'Business'
  when lower(value) like '%boat%' or lower(value) like '%motorcycle%' or lower(value) like '%caravan%' then 'Vehicle Other'
  when lower(value) like '%debt%' or lower(value) like '%restructuring%' then 'Debt Management'
  when lower(value) like '%tax%' then 'Tax and Payments' else 'Other' end as replacement
from c where n / (select sum(n) from c) < 0.01""")
def rare_category_groups(spark, sf):
    return encode.RareCategories("goal").fit(goals_log(spark, sf), "case_id", "nr").mapping


def goals_log(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, " for Business").when(F.col("p_partkey") % 3 == 1, " boat TAX").otherwise("")
    goal = table(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("goal"))
    lines = table(spark, sf, "lineitem").join(goal, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("case_id"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("nr"), "goal")


@query("rare_categories_applied", "EN-2 PR-13", """
with b as (select p_partkey, p_name || case when p_partkey % 3 = 0 then ' for Business' when p_partkey % 3 = 1 then ' boat TAX' else '' end as goal from part),
f as (select l_orderkey as case_id, min_by(goal, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) as value from lineitem join b on l_partkey = p_partkey group by l_orderkey),
c as (select value, count(*) as n from f group by value),
r as (select value, case when lower(value) like '%business%' then 'Business' when lower(value) like '%boat%' then 'Vehicle Other' else 'Other' end as replacement
  from c where n / (select sum(n) from c) < 0.01)
select l_orderkey as case_id, coalesce(replacement, goal) as goal, count(*) as n
from lineitem join b on l_partkey = p_partkey left join r on goal = value group by all""")
def rare_categories_applied(spark, sf):
    log = goals_log(spark, sf)
    fitted = encode.RareCategories("goal").fit(log, "case_id", "nr")
    return fitted.transform(log, "case_id").groupBy("case_id", "goal").agg(F.count(F.lit(1)).alias("n"))


@query("static_block", "EN-3 AG-1", f"""
with {LOG_SQL} select case_id, min_by(o_totalprice, event_nr) as o_totalprice, min_by(pr, event_nr) as pr, min_by(l_quantity, event_nr) filter (where l_quantity > 5) as qty,
  min_by(label, event_nr) as label from log where event_nr <= {K} group by case_id""")
def static_block(spark, sf):
    log = order_log(spark, sf, parts=False).withColumn("qty", F.when(F.col("l_quantity") > 5, F.col("l_quantity")))
    return encode.static_block(log, "case_id", "event_nr", ["o_totalprice", "pr", "qty", "label"], K)


@query("static_block_whole_case", "EN-3 EN-11", f"""
with {LOG_SQL} select case_id, min_by(o_totalprice, event_nr) as o_totalprice, min_by(l_quantity, event_nr) filter (where l_quantity > 45) as qty from log group by case_id""")
def static_block_whole_case(spark, sf):
    log = order_log(spark, sf, parts=False).withColumn("qty", F.when(F.col("l_quantity") > 45, F.col("l_quantity")))
    return encode.static_block(log, "case_id", "event_nr", ["o_totalprice", "qty"])


@query("category_vocabulary", "EN-4 EN-5 IO-8", f"""
with {CAT_SQL} select source, cast(event_nr as integer) as event_nr, value, feature, count(*) as n_cells,
  row_number() over (partition by source, event_nr order by value) - 1 as idx from named group by source, event_nr, value, feature""")
def category_vocabulary(spark, sf):
    cells = encode.category_cells(order_log(spark, sf), "case_id", "event_nr", K, "act", ["cat"])
    return encode.vocabulary(cells, "event_nr")


CATS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ACTS = ["A", "N", "R"]


@query("one_hot_categories", "EN-4", f"with {LOG_SQL} select case_id, " + ", ".join(
    f"max(case when event_nr = {n} and cat = '{v}' then 1.0::double else 0 end) as cat_event{n}_{v}" for n in (1, 2) for v in CATS)
    + " from log where case_length >= 2 and event_nr <= 2 group by case_id")
def one_hot_categories(spark, sf):
    log = order_log(spark, sf)
    vocab = encode.vocabulary(encode.category_cells(log, "case_id", "event_nr", 2, None, ["cat"]), "event_nr")
    entries = [(r["source"], r["event_nr"], r["value"]) for r in features.small_table(vocab, 1000)]
    return encode.wide_one_hot(log, "case_id", "event_nr", sorted(entries))


@query("one_hot_events", "EN-5", f"with {LOG_SQL} select case_id, " + ", ".join(
    f"max(case when event_nr = {n} and act = '{v}' then 1.0::double else 0 end) as event{n}_{v}" for n in (1, 2, 3) for v in ACTS)
    + " from log where event_nr <= 3 group by case_id")
def one_hot_events(spark, sf):
    log = order_log(spark, sf, parts=False)
    vocab = encode.vocabulary(encode.category_cells(log, "case_id", "event_nr", 3, "act", []), "event_nr")
    entries = [(r["source"], r["event_nr"], r["value"]) for r in features.small_table(vocab, 1000)]
    return encode.wide_one_hot(log, "case_id", "event_nr", sorted(entries), keep_short=True, names={encode.EVENT_NAME: "act"})


@query("dynamic_columns", "EN-6 EN-7 EN-9", f"with {LOG_SQL} select case_id, " + ", ".join(
    f"coalesce(max(case when event_nr = {n} then {c} end), 0) as {c}_event{n}" for c in ("l_quantity", "l_extendedprice") for n in range(1, K + 1))
    + f" from log where case_length >= {K} and event_nr <= {K} group by case_id")
def dynamic_columns(spark, sf):
    return encode.wide_numbers(order_log(spark, sf, parts=False), "case_id", "event_nr", K, ["l_quantity", "l_extendedprice"])


@query("dynamic_columns_keep_short", "EN-6 EN-7 EN-10", f"with {LOG_SQL} select case_id, " + ", ".join(
    f"coalesce(max(case when event_nr = {n} then l_quantity end), 0) as l_quantity_event{n}" for n in range(1, 6))
    + " from log where event_nr <= 5 group by case_id")
def dynamic_columns_keep_short(spark, sf):
    return encode.wide_numbers(order_log(spark, sf, parts=False), "case_id", "event_nr", 5, ["l_quantity"], keep_short=True)


@query("last_state_values", "EN-8", f"with {LOG_SQL} select case_id, max_by(txt, event_nr) as txt, max_by(act, event_nr) as act from log where event_nr <= {K} group by case_id")
def last_state_values(spark, sf):
    return encode.last_state_block(order_log(spark, sf), "case_id", "event_nr", ["txt", "act"], K)


@query("ordinal_events", "EN-11 PR-15", f"""
with {LOG_SQL}, codes as (select cat, row_number() over (order by cat) as code from (select distinct cat from log)) select case_id, """ + ", ".join(
    f"coalesce(max(case when event_nr = {n} then code end), 0) as cat_event{n}" for n in range(1, K + 1)) + f" from log join codes using (cat) where event_nr <= {K} group by case_id")
def ordinal_events(spark, sf):
    log = order_log(spark, sf)
    return encode.ordinal_block(log, "case_id", "event_nr", K, clean.ordinal_table(log, "cat"), "cat")


@query("encoded_cells", "EN-13 EN-12", f"with {CELLS_SQL} select case_id, cast(event_nr as integer) as event_nr, feature, number from cells")
def encoded_cells(spark, sf):
    return order_cells(spark, sf)


@query("feature_shares", "AG-12 MO-1", f"""
with {CELLS_SQL} select feature, count(*) as n, round(count(*) / (select count(distinct case_id) from log)::double, 6) as share from cells group by feature""")
def feature_shares(spark, sf):
    log = order_log(spark, sf, parts=False)
    cases = log.filter("event_nr = 1").agg(F.count(F.lit(1)).alias("n_cases"))
    return features.nonzero_shares(order_cells(spark, sf), cases).withColumn("share", F.round("share", 6))


@query("kept_features", "MO-1", f"""
with {CELLS_SQL}, s as (select feature, count(*) / (select count(distinct case_id) from log)::double as share from cells group by feature)
select feature from s where share >= 0.2""")
def kept_features(spark, sf):
    log = order_log(spark, sf, parts=False)
    cases = log.filter("event_nr = 1").agg(F.count(F.lit(1)).alias("n_cases"))
    return features.kept(features.nonzero_shares(order_cells(spark, sf), cases), 0.2).select("feature")


@query("aligned_cells", "MO-4 ST-3", f"""
with {CELLS_SQL}, sided as (select *, cast('0x' || substr(md5(cast(case_id as varchar) || '_22'), 1, 8) as bigint) / 4294967296.0 < 0.8 as is_train from cells),
train as (select distinct feature from sided where is_train)
select case_id, feature, number from sided where not is_train and feature in (select feature from train)""")
def aligned_cells(spark, sf):
    sided = split.split_threshold(order_cells(spark, sf), "case_id", 0.8)
    train = sided.filter("is_train").select("feature").distinct()
    return features.align(sided.filter("not is_train"), train).select("case_id", "feature", "number")


@query("missing_and_extra_features", "ST-3", """
with a as (select distinct o_orderpriority || '_' || o_orderstatus as feature from orders where o_totalprice > 300000),
b as (select distinct o_orderpriority || '_' || o_orderstatus as feature from orders where o_totalprice < 2000)
select feature, 'missing' as kind from (select feature from a except select feature from b)
union all select feature, 'extra' from (select feature from b except select feature from a)
union all select cast(count(*) as varchar), 'train features' from a""")
def missing_and_extra_features(spark, sf):
    named = table(spark, sf, "orders").withColumn("feature", F.concat_ws("_", "o_orderpriority", "o_orderstatus"))
    train = named.filter("o_totalprice > 300000").select("feature").distinct()
    test = named.filter("o_totalprice < 2000").select("feature").distinct()
    size = train.agg(F.count(F.lit(1)).cast("string").alias("feature")).withColumn("kind", F.lit("train features"))
    return features.column_differences(train, test).unionByName(size)


@query("missing_and_extra_features_by_side", "ST-3", """
with o as (select o_orderpriority || '_' || o_orderstatus as feature, cast('0x' || substr(md5(cast(o_orderkey as varchar) || '_22'), 1, 8) as bigint) / 4294967296.0 < 0.8 as is_train from orders),
a as (select distinct feature from o where is_train), b as (select distinct feature from o where not is_train)
select feature, 'missing' as kind from (select feature from a except select feature from b)
union all select feature, 'extra' from (select feature from b except select feature from a)
union all select cast(count(*) as varchar), 'train features' from a""")
def missing_and_extra_features_by_side(spark, sf):
    """As above over all orders, each on the training or the test side."""
    sided = split.split_threshold(table(spark, sf, "orders").withColumn("feature", F.concat_ws("_", "o_orderpriority", "o_orderstatus")), "o_orderkey", 0.8)
    train = sided.filter("is_train").select("feature").distinct()
    test = sided.filter("not is_train").select("feature").distinct()
    size = train.agg(F.count(F.lit(1)).cast("string").alias("feature")).withColumn("kind", F.lit("train features"))
    return features.column_differences(train, test).unionByName(size)


@query("standard_scaled", "MO-5", f"""
with {LOG_SQL}, w as (select case_id, coalesce(max(case when event_nr = 1 then l_quantity end), 0) as q1, coalesce(max(case when event_nr = 2 then l_extendedprice end), 0) as p2
  from log where case_length >= 2 and event_nr <= 2 group by case_id), s as (select avg(q1) as mq, stddev_pop(q1) as sq, avg(p2) as mp, stddev_pop(p2) as sp from w)
select case_id, round((q1 - mq) / sq, 6) as q1, round((p2 - mp) / sp, 6) as p2 from w, s""")
def standard_scaled(spark, sf):
    wide = encode.wide_numbers(order_log(spark, sf, parts=False), "case_id", "event_nr", 2, ["l_quantity", "l_extendedprice"])
    two = wide.select("case_id", F.col("l_quantity_event1").alias("q1"), F.col("l_extendedprice_event2").alias("p2"))
    return clean.zscore(two, ["q1", "p2"], population=True, guard=False).select("case_id", F.round("q1", 6).alias("q1"), F.round("p2", 6).alias("p2"))


@query("class_weights", "MO-6", f"""
with {LOG_SQL}, c as (select case_id, max(label) as label from log group by case_id), n as (select label, count(*) as n_cases from c group by label)
select label, n_cases, round((select count(*) from c) / ((select count(*) from n) * n_cases)::double, 6) as weight from n""")
def class_weights(spark, sf):
    cases = order_log(spark, sf, parts=False).filter("event_nr = 1")
    return features.class_weights(cases, "label").withColumn("weight", F.round("weight", 6))


@query("text_columns_picked", "MO-2 PR-14", f"""
with {LOG_SQL} select case_id, """ + ", ".join(f"coalesce(max(case when event_nr = {n} then txt end), '') as txt_event{n}" for n in (1, 2, 3))
       + " from log where event_nr <= 3 group by case_id")
def text_columns_picked(spark, sf):
    log = order_log(spark, sf).filter("event_nr <= 3")
    wide = log.groupBy("case_id").agg(*[F.max(F.when(F.col("event_nr") == n, F.col("txt"))).alias(f"txt_event{n}") for n in (1, 2, 3)],
                                      F.max("o_totalprice").alias("o_totalprice"))
    return features.text_columns(wide, "txt", keep=["case_id"])
