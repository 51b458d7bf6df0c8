"""Row-wise queries: cleaning, expressions, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.functions import scalars as S
from caselog.functions import text as T
from caselog.operators import clean
from caselog.plans.logs import ALL_DOCS_SQL, LOG_SQL, SCORES_SQL, all_documents, order_log, order_scores, table
from caselog.plans.registry import query

ROW = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("lenient_timestamps", "PR-1 PR-3", """
with t as (select event_id, case when event_type = 'error' then 'n/a' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as txt from events)
select event_id, cast(floor(epoch(try_cast(txt as timestamp))) as bigint) as epoch_s from t""")
def lenient_timestamps(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", S.epoch_seconds(S.lenient_timestamp(text)).alias("epoch_s"))


@query("dotted_timestamps", "PR-2 PR-3", """
with t as (select event_id, case when event_type = 'error' then 'zz' else strftime(ts, '%d.%m.%Y %H:%M') end as txt from events)
select event_id, cast(floor(epoch(try_strptime(txt, '%d.%m.%Y %H:%M'))) as bigint) as epoch_s from t""")
def dotted_timestamps(spark, sf):
    text = F.when(F.col("event_type") == "error", "zz").otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm"))
    return table(spark, sf, "events").select(
        "event_id", S.epoch_seconds(S.lenient_timestamp(text, "dd.MM.yyyy HH:mm")).alias("epoch_s"))


@query("clean_text_log", "PR-1 PR-3 PR-4 PR-5", """
select event_id, cast(floor(epoch(ts)) as bigint) as start_time,
  case when event_type = 'purchase' then 1 else 0 end as accepted,
  case when event_type in ('error', 'view') then 0.0 else cast(event_id % 1000 as double) end as amount
from events""")
def clean_text_log(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.when(F.col("event_type") == "purchase", "TRUE").when(F.col("event_type") == "view", "False")
        .when(F.col("event_type") == "click", "yes").alias("accepted"),
        F.when(F.col("event_type") == "error", "x").when(
            F.col("event_type") != "view", F.concat(F.lit(" "), (F.col("event_id") % 1000).cast("string"))).alias("amount"))
    return clean.clean_log(raw, ["start_time"], ["accepted"], ["amount"])


@query("lowered_text", "PR-6 PR-7", "select cast(doc_id as varchar) as case_name, lower(text) as text from documents")
def lowered_text(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("case_name"), F.lower("text").alias("text"))


@query("last_state_as_log", "PR-8 AG-2", """
select cast(user_id as bigint) as user_id, max_by(event_type, event_id) as act, max_by(value, event_id) as value, cast(1 as integer) as event_nr
from events group by user_id""")
def last_state_as_log(spark, sf):
    from caselog.operators.events import last_state

    return last_state(table(spark, sf, "events"), "user_id", "event_id", ["event_type", "value"]).select(
        "user_id", F.col("event_type").alias("act"), "value", F.lit(1).alias("event_nr"))


@query("zscored_orders", "PR-9", """
with s as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as d from orders)
select o_orderkey, round((o_totalprice - m) / d, 6) as z_price, cast(1 as double) as z_const from orders, s""")
def zscored_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("z_price"), F.lit(1.0).alias("z_const"))
    return clean.zscore(orders, ["z_price", "z_const"]).withColumn("z_price", F.round("z_price", 6))


@query("ratio_features", "PR-10 PR-12", """
with f as (select l_orderkey as case_id, sum(l_extendedprice) as amount, sum(l_tax) as monthly, sum(l_quantity) as score, count(*) as terms
  from lineitem group by l_orderkey)
select case_id, round(coalesce(score / nullif(amount, 0), 0), 6) as credit_to_amount,
  round(case when round(monthly, 6) = 0 then 0 else score / round(monthly, 6) end, 4) as credit_to_monthly,
  round(coalesce(score * terms / nullif(amount, 0), 0), 6) as risk_score, round(round(monthly, 6) * terms, 6) as total_cost,
  round(coalesce(round(monthly, 6) * terms / nullif(amount, 0), 0), 9) as cost_to_amount from f""")
def ratio_features(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.sum("l_extendedprice").alias("amount"), F.round(F.sum("l_tax"), 6).alias("monthly"),
        F.sum("l_quantity").alias("score"), F.count(F.lit(1)).alias("terms"))
    f = clean.finite_table(clean.ratio_features(sums, "amount", "monthly", "score", "terms"))
    return f.select("case_id", F.round("credit_to_amount", 6).alias("credit_to_amount"),
                    F.round("credit_to_monthly", 4).alias("credit_to_monthly"), F.round("risk_score", 6).alias("risk_score"),
                    F.round("total_cost", 6).alias("total_cost"), F.round("cost_to_amount", 9).alias("cost_to_amount"))


@query("durations", "PR-11", """
with d as (select o_orderkey as case_id, cast(floor(epoch(max(l_shipdate))) as bigint) - cast(floor(epoch(min(o_orderdate))) as bigint) as x
  from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey),
s as (select avg(x) as m, stddev_samp(x) as sd from d)
select case_id, round((x - m) / sd, 6) as process_duration from d, s""")
def durations(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    d = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("case_id"),
        (S.epoch_seconds("done") - S.epoch_seconds("o_orderdate")).cast("double").alias("process_duration"))
    return clean.zscore(d, ["process_duration"], guard=False).withColumn("process_duration", F.round("process_duration", 6))


@query("finite_values", "PR-12 PR-14", """
select event_id, case when event_type = 'error' then 0.0 when value - 10 <= 0 then 0.0 else round(ln(value - 10), 6) end as x,
  case when event_type = 'error' then '' else event_type end as act from events""")
def finite_values(spark, sf):
    x = F.when(F.col("event_type") != "error", F.when(F.col("value") - 10 <= 0, F.lit(float("-inf"))).otherwise(F.log(F.col("value") - 10)))
    raw = table(spark, sf, "events").select(
        "event_id", x.alias("x"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("act"))
    return clean.finite_table(raw).withColumn("x", F.round("x", 6))


@query("replaced_values", "PR-13", """
select event_id, case event_type when 'view' then 'seen' when 'click' then 'used' else event_type end as act from events""")
def replaced_values(spark, sf):
    return table(spark, sf, "events").select("event_id", S.replace_values("event_type", {"view": "seen", "click": "used"}).alias("act"))


@query("null_sentinels", "PR-14", """
select event_id, case when event_type = 'view' then 'MISSING' else event_type end as act,
  case when event_type = 'view' then '' else event_type end as txt, case when event_type = 'view' then 0.0 else value end as amount from events""")
def null_sentinels(spark, sf):
    seen = F.col("event_type") != "view"
    return table(spark, sf, "events").select(
        "event_id", S.or_missing(F.when(seen, F.col("event_type"))).alias("act"), S.or_empty(F.when(seen, F.col("event_type"))).alias("txt"),
        F.coalesce(F.when(seen, F.col("value")), F.lit(0.0)).alias("amount"))


@query("ordinal_codes", "PR-15 MO-3", """
with v as (select p_brand, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part))
select p_partkey, code as brand_code from part join v using (p_brand)""")
def ordinal_codes(spark, sf):
    return clean.ordinal_codes(table(spark, sf, "part"), "p_brand", "brand_code").select("p_partkey", "brand_code")


@query("event_descriptions", "PR-16 UD-1", """
with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as event, l_linestatus as origin, cast(cast(l_quantity as integer) as varchar) as amount,
    p_type as kind, p_name as goal,
    cast('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || '_42'), 1, 6) as bigint) % 10 as pick
  from lineitem join part on l_partkey = p_partkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case pick
  when 0 then event || ' for a ' || kind || ' application.'
  when 1 then 'Loan goal: ' || goal || '. Processing event: ' || event || '.'
  when 2 then 'An application for ' || goal || ' was ' || origin || '.'
  when 3 then 'Requested amount of ' || amount || ' is under review.'
  when 4 then 'The event ''' || event || ''' occurred for a case related to ' || kind || '.'
  when 5 then 'Details processed for loan amount: ' || amount || '.'
  when 6 then event || ' initiated for a ' || kind || ' with goal: ' || goal || '.'
  when 7 then 'Action recorded during application review.'
  when 8 then 'Application event is being tracked for compliance.'
  else 'Loan application event: ' || origin || '.' end as description from t""")
def event_descriptions(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keyed = lines.withColumn("row_key", F.expr(ROW)).withColumn("amount", F.col("l_quantity").cast("int"))
    roles = {"event": "l_returnflag", "kind": "p_type", "goal": "p_name", "origin": "l_linestatus", "amount": "amount"}
    return clean.describe_events(keyed, "row_key", roles, "description").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "description")


@query("lemmatised_texts", "PR-17", f"""
with {ALL_DOCS_SQL}, tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as token,
    generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), 1) as pos from docs),
lex as (select distinct token, substr(token, 1, length(token) - 1) as lemma from tok where token like '%s' and length(token) > 3),
lem as (select doc_id, pos, coalesce(lemma, token) as w from tok left join lex using (token)),
joined as (select doc_id, string_agg(w, ' ' order by pos) as lemmas from lem group by doc_id)
select doc_id, coalesce(lemmas, '') as lemmas from docs left join joined using (doc_id)""")
def lemmatised_texts(spark, sf):
    docs = all_documents(spark, sf).select("doc_id", T.words("text").alias("tokens"))
    seen = docs.select(F.explode("tokens").alias("token")).distinct()
    lexicon = seen.filter(F.col("token").endswith("s") & (F.length("token") > 3)).select(
        "token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return clean.lemmatise(docs, "doc_id", "tokens", lexicon, "lemmas").select("doc_id", "lemmas")


@query("hard_labels", "PR-18", f"""
with {SCORES_SQL} select case_id, event_nr, cast(case when least(score, 1) > 1 - least(score, 1) then 1 else 0 end as integer) as prediction from scores""")
def hard_labels(spark, sf):
    p = F.least(F.col("score"), F.lit(1.0))
    return order_scores(spark, sf).select("case_id", "event_nr", S.first_max_index(F.array(1.0 - p, p)).alias("prediction"))


@query("projected_columns", "PR-19", "select l_extendedprice as price, l_orderkey as case_id, l_linenumber from lineitem")
def projected_columns(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("case_id"), "l_linenumber")


@query("rounded_report", "PR-20", """
select l_returnflag as act, round(avg(l_discount), 3) as mean_discount, cast(count(*) as integer) as support from lineitem group by l_returnflag""")
def rounded_report(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("act")).agg(
        F.round(F.avg("l_discount"), 3).alias("mean_discount"), F.count(F.lit(1)).cast("int").alias("support"))


@query("events_at_number", "FI-1", f"with {LOG_SQL} select case_id, act, cat from log where event_nr = 2")
def events_at_number(spark, sf):
    return order_log(spark, sf).filter("event_nr = 2").select("case_id", "act", "cat")


@query("events_up_to_number", "FI-1 EN-9", f"with {LOG_SQL} select case_id, event_nr, act from log where event_nr <= 3 and case_length >= 3")
def events_up_to_number(spark, sf):
    return order_log(spark, sf).filter("event_nr <= 3 and case_length >= 3").select("case_id", "event_nr", "act")


@query("cases_in_set", "FI-2 JN-3", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT')""")
def cases_in_set(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("cases_not_in_set", "FI-3 JN-4", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT')""")
def cases_not_in_set(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("confident_rows", "FI-5", f"""
with {SCORES_SQL} select case_id, event_nr, round(score, 9) as score from scores where greatest(score, 1 - score) >= 0.8""")
def confident_rows(spark, sf):
    p = F.array(1.0 - F.col("score"), F.col("score"))
    return order_scores(spark, sf).filter(F.array_max(p) >= 0.8).select("case_id", "event_nr", F.round("score", 9).alias("score"))


@query("two_key_lookup", "FI-6", "select o_orderkey, o_totalprice from orders where o_orderpriority = '2-HIGH' and o_orderstatus = 'P'")
def two_key_lookup(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH' and o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
