"""Source and sink queries: each writes a derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.functions import text as T
from caselog.operators import monitor, text, tune
from caselog.operators.ranks import contiguous_ids
from caselog.plans.logs import ALL_DOCS_SQL, CONF_SQL, SCORES_SQL, all_documents, order_scores, table
from caselog.plans.registry import query
from caselog.sources import files


@query("text_file_roundtrip", "IO-1 IO-3", """
select cast(event_id as varchar) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, event_type, cast(user_id as varchar) as user_id from events""")
def text_file_roundtrip(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "user_id")
    path = files.shared_folder(spark, "text-log")
    files.write_log(events, path)
    return files.read_text_log(spark, path, ["event_id", "ts", "event_type", "user_id"])


@query("typed_file_roundtrip", "IO-2 IO-4", "select doc_id, lang, source, n_chars, text from documents")
def typed_file_roundtrip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = files.shared_folder(spark, "typed-log")
    files.write_log(docs, path, sep=",")
    return files.read_typed_log(spark, path, "doc_id bigint, lang string, source string, n_chars bigint, text string", sep=",")


@query("inferred_file_roundtrip", "IO-2", "select o_orderkey, o_custkey, o_orderpriority from orders")
def inferred_file_roundtrip(spark, sf):
    path = files.shared_folder(spark, "inferred-log")
    files.write_log(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return files.read_typed_log(spark, path).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderpriority")


@query("metric_sink_append", "IO-5", f"""
with {SCORES_SQL}, {CONF_SQL}, a as (
  select confidence, cast(count(distinct case when score >= confidence then case_id end) as double) as value from scores, confs group by confidence)
select confidence, value, 'n_alerts' as metric, run from a, (select unnest(['first', 'second']) as run) where confidence = 0.6 or run = 'second'""")
def metric_sink_append(spark, sf):
    fired = monitor.alerts(monitor.decisions(order_scores(spark, sf), "case_id", "event_nr", monitor.CONFIDENCES))
    counts = fired.groupBy("confidence").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("n_alerts"))
    path = files.shared_folder(spark, "metrics")
    files.write_metrics(counts.filter("confidence = 0.6"), path, "w", run="first")
    files.write_metrics(counts, path, "a", run="second")
    return files.read_metrics(spark, path, with_run=True)


@query("cases_per_prefix", "IO-6 MN-1", f"""
with {SCORES_SQL} select cast(event_nr as integer) as nr_events, count(*) as nr_test_cases from scores group by event_nr""")
def cases_per_prefix(spark, sf):
    return order_scores(spark, sf).groupBy(F.col("event_nr").alias("nr_events")).agg(F.count(F.lit(1)).alias("nr_test_cases"))


@query("result_names", "IO-7", r"""
with n as (select p_partkey, case p_partkey % 5
    when 0 then 'bong_selected' || (p_size * 10) || '_tfidf_ngram' || (p_partkey % 3 + 1) || '_rf_part' || (p_partkey % 5 + 1)
    when 1 then 'bong_selected' || (p_size * 10) || '_ngram' || (p_partkey % 3 + 1) || '_logit_part' || (p_partkey % 5 + 1)
    when 2 then 'nb_selected' || (p_size * 10) || '_alpha0.' || (p_partkey % 9 + 1) || '_ngram1_logit_part' || (p_partkey % 5 + 1)
    when 3 then 'lda_k' || p_size || '_tfidf_rf_part' || (p_partkey % 5 + 1)
    else 'optimal_params_' || p_size end as name, p_size from part)
select p_partkey, name, split_part(name, '_', 1) as family,
  case when p_partkey % 5 <= 2 then cast(p_size * 10 as varchar) end as selected,
  case when p_partkey % 5 = 2 then '0.' || (p_partkey % 9 + 1) end as alpha,
  case when p_partkey % 5 = 2 then '1' when p_partkey % 5 < 2 then cast(p_partkey % 3 + 1 as varchar) end as ngram,
  case when p_partkey % 5 = 3 then cast(p_size as varchar) end as k,
  case when p_partkey % 5 in (0, 3) then 'tfidf' when p_partkey % 5 = 1 then 'no-tfidf' end as tfidf,
  case when p_partkey % 5 in (0, 3) then 'rf' else 'logit' end as cls, cast(p_partkey % 5 + 1 as varchar) as part
from n where p_partkey % 5 <> 4""")
def result_names(spark, sf):
    def s(e):
        return f"cast({e} as string)"

    part = f"concat('_part', {s('p_partkey % 5 + 1')})"
    name = F.expr(f"""case p_partkey % 5
      when 0 then concat('bong_selected', {s('p_size * 10')}, '_tfidf_ngram', {s('p_partkey % 3 + 1')}, '_rf', {part})
      when 1 then concat('bong_selected', {s('p_size * 10')}, '_ngram', {s('p_partkey % 3 + 1')}, '_logit', {part})
      when 2 then concat('nb_selected', {s('p_size * 10')}, '_alpha0.', {s('p_partkey % 9 + 1')}, '_ngram1_logit', {part})
      when 3 then concat('lda_k', {s('p_size')}, '_tfidf_rf', {part})
      else concat('optimal_params_', {s('p_size')}) end""")
    named = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return tune.parse_names(named, "name").drop("size", "window")


@query("scanned_results", "IO-5 IO-7", f"""
with {SCORES_SQL}, {CONF_SQL}, a as (
  select confidence, cast(count(distinct case when score >= confidence then case_id end) as double) as value from scores, confs group by confidence)
select confidence, value, 'pv' as family, '10' as size, '9' as "window", 'rf' as cls, '4' as part from a""")
def scanned_results(spark, sf):
    fired = monitor.alerts(monitor.decisions(order_scores(spark, sf), "case_id", "event_nr", monitor.CONFIDENCES))
    counts = fired.groupBy("confidence").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("n_alerts"))
    folder = files.shared_folder(spark, "results")
    files.write_metrics(counts, f"{folder}/pv_size10_window9_rf_part4")
    return files.scan_results(spark, f"{folder}/*").select("confidence", "value", "family", "size", "window", "cls", "part")


@query("saved_dictionary", "IO-8 TX-4", f"""
with {ALL_DOCS_SQL}, t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from docs)
select term, count(distinct doc_id) as df, row_number() over (order by term) - 1 as idx from t group by term""")
def saved_dictionary(spark, sf):
    docs = all_documents(spark, sf)
    path = files.shared_folder(spark, "dictionary")
    files.save_dictionary(text.sorted_vocabulary(text.term_counts(docs, "doc_id", T.words("text"))), path)
    return files.load_dictionary(spark, path)


@query("contiguous_ids", "IO-9", """
select event_id, row_number() over (order by value, event_id) as unique_id from events""")
def contiguous_event_ids(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return contiguous_ids(events, "value", "unique_id", "event_id").select("event_id", "unique_id")
