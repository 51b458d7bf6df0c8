"""Term weights and selections on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.functions import text as T
from caselog.operators import features, text
from caselog.plans.logs import ALL_DOCS_SQL, DOCS_SQL, LOG_SQL, all_documents, labelled_documents, order_log
from caselog.plans.registry import query

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
TOK_SQL = DOCS_SQL + f", tok as (select doc_id, quality, unnest({WORDS}) as term from docs), tf as (select doc_id, quality, term, count(*) as tf from tok group by all)"
DF_SQL = TOK_SQL + ", df as (select term, count(*) as df from tf group by term), nd as (select count(*)::double as n from docs)"
TFIDF_SQL = DF_SQL + """, raw as (select doc_id, quality, term, tf, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w from tf join df using (term), nd),
norm as (select doc_id, sqrt(sum(w * w)) as nn from raw group by doc_id), tfidf as (select doc_id, quality, term, tf, w / nn as weight from raw join norm using (doc_id))"""


def chi_sql(cells, weight, prefix):
    return f"""{prefix}, share as (select quality, count(*) / (select count(*) from docs)::double as s from docs group by quality),
tot as (select term, sum({weight})::double as t from {cells} group by term), obs as (select term, quality, sum({weight})::double as o from {cells} group by all),
chi as (select term, sum((coalesce(o, 0) - s * t) * (coalesce(o, 0) - s * t) / (s * t)) as chi2 from tot cross join share left join obs using (term, quality) group by term)"""


# the same over every document; nothing after it asks for a label
ALL_DF_SQL, ALL_TOK_SQL, ALL_TFIDF_SQL = (sql.replace(DOCS_SQL, ALL_DOCS_SQL).replace("quality, ", "") for sql in (DF_SQL, TOK_SQL, TFIDF_SQL))


def all_word_cells(spark, sf):
    return text.term_counts(all_documents(spark, sf), "doc_id", T.words("text"))


def word_cells(spark, sf, keep=("quality",)):
    return text.term_counts(labelled_documents(spark, sf), "doc_id", T.words("text"), list(keep))


@query("word_tokens", "TX-1", f"with {ALL_DOCS_SQL} select doc_id, array_to_string({WORDS}, ' ') as tokens from docs")
def word_tokens(spark, sf):
    return all_documents(spark, sf).select("doc_id", F.array_join(T.words("text"), " ").alias("tokens"))


@query("whitespace_tokens", "TX-2", f"""
with {ALL_DOCS_SQL}, s as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as t from docs)
select doc_id, cast(len(t) as integer) as n_tokens, array_to_string(t, ' ') as tokens from s""")
def whitespace_tokens(spark, sf):
    t = T.split_tokens("text")
    return all_documents(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("ngram_counts", "TX-3 TX-5", f"""
with {ALL_DOCS_SQL}, s as (select doc_id, {WORDS} as t from docs),
g as (select doc_id, unnest(t) as term from s union all select doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from s)
select doc_id, term, count(*) as tf from g group by all""")
def ngram_counts(spark, sf):
    return text.term_counts(all_documents(spark, sf), "doc_id", T.words("text"), ngram=(1, 2))


@query("trigram_counts", "TX-3", f"""
with {ALL_DOCS_SQL}, s as (select doc_id, {WORDS} as t from docs),
g as (select doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) as term from s)
select term, count(*) as n from g group by all""")
def trigram_counts(spark, sf):
    cells = text.term_counts(all_documents(spark, sf), "doc_id", T.words("text"), ngram=(3, 3))
    return cells.groupBy("term").agg(F.sum("tf").alias("n"))


@query("sorted_vocabulary", "TX-4", f"with {ALL_DF_SQL} select term, df, row_number() over (order by term) - 1 as idx from df")
def sorted_vocabulary(spark, sf):
    return text.sorted_vocabulary(all_word_cells(spark, sf))


@query("tfidf_weights", "TX-6", f"with {ALL_TFIDF_SQL} select doc_id, term, tf, round(weight, 6) as weight from tfidf")
def tfidf_weights(spark, sf):
    cells = all_word_cells(spark, sf)
    n = all_documents(spark, sf).agg(F.count(F.lit(1)).alias("n_docs"))
    return text.tfidf(cells, "doc_id", text.document_frequencies(cells), n).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query("topic_tfidf_weights", "TX-7", f"""
with {ALL_DF_SQL}, raw as (select doc_id, term, tf * log2(n / df) as w from tf join df using (term), nd), norm as (select doc_id, sqrt(sum(w * w)) as nn from raw group by doc_id)
select doc_id, term, round(w / nn, 6) as weight from raw join norm using (doc_id)""")
def topic_tfidf_weights(spark, sf):
    cells = all_word_cells(spark, sf)
    n = all_documents(spark, sf).agg(F.count(F.lit(1)).alias("n_docs"))
    w = text.tfidf(cells, "doc_id", text.document_frequencies(cells), n, form="log2")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("frequent_token_cells", "TX-8", f"""
with {ALL_TOK_SQL}, c as (select term, sum(tf) as n from tf group by term having sum(tf) > 5) select doc_id, term, tf from tf where term in (select term from c)""")
def frequent_token_cells(spark, sf):
    docs = all_documents(spark, sf)
    return text.keep_terms(all_word_cells(spark, sf), "doc_id", text.frequent_tokens(docs, T.words("text"), 5))


@query("chi_square_scores", "TX-9", f"with {chi_sql('tf', 'tf', TOK_SQL)} select term, round(chi2, 6) as chi2 from chi")
def chi_square_scores(spark, sf):
    shares = text.class_shares(labelled_documents(spark, sf), "quality")
    return text.chi_square(word_cells(spark, sf), "quality", "tf", shares).withColumn("chi2", F.round("chi2", 6))


@query("best_terms", "SO-3 TX-9", f"with {chi_sql('tf', 'tf', TOK_SQL)} select term, round(chi2, 6) as chi2 from chi order by chi.chi2 desc, term limit 100")
def best_terms(spark, sf):
    shares = text.class_shares(labelled_documents(spark, sf), "quality")
    scores = text.chi_square(word_cells(spark, sf), "quality", "tf", shares)
    return text.top_terms(scores, "chi2", 100).withColumn("chi2", F.round("chi2", 6))


@query("selected_ngrams", "TX-10", f"""
with {chi_sql('tf', 'tf', TOK_SQL)}, best as (select term from chi order by chi2 desc, term limit 100)
select doc_id, term, tf::double as weight from tf where term in (select term from best)""")
def selected_ngrams(spark, sf):
    docs = labelled_documents(spark, sf).select("doc_id", "text", "quality")
    return text.NGramSelector("doc_id", "text", "quality", nr_selected=100).fit(docs).transform(docs)


@query("selected_ngrams_tfidf", "TX-10 TX-6", f"""
with {chi_sql('tfidf', 'weight', TFIDF_SQL)}, best as (select term from chi order by round(chi2, 9) desc, term limit 100)
select doc_id, term, round(weight, 6) as weight from tfidf where term in (select term from best)""")
def selected_ngrams_tfidf(spark, sf):
    docs = labelled_documents(spark, sf).select("doc_id", "text", "quality")
    return text.NGramSelector("doc_id", "text", "quality", tfidf=True, nr_selected=100).fit(docs).transform(docs).withColumn("weight", F.round("weight", 6))


@query("selected_term_columns", "TX-10", f"""
with {chi_sql('tf', 'tf', TOK_SQL)}, best as (select term, row_number() over (order by chi2 desc, term) as rk from chi qualify rk <= 5)
select doc_id, """ + ", ".join(f"coalesce(sum(case when rk = {i} then tf end), 0)::double as t{i}" for i in range(1, 6)) + """
from docs left join (select * from tf join best using (term)) using (doc_id) group by doc_id""")
def selected_term_columns(spark, sf):
    docs = labelled_documents(spark, sf).select("doc_id", "text", "quality")
    chosen = text.NGramSelector("doc_id", "text", "quality", nr_selected=5).fit(docs)
    names = [r["term"] for r in features.small_table(chosen.selected.orderBy(F.desc("chi2"), "term"), 5)]
    wide = text.term_columns(chosen.transform(docs), "doc_id", "weight", names, docs)
    return wide.select("doc_id", *[F.col(f"`{n}`").alias(f"t{i}") for i, n in enumerate(names, 1)])


RATIO_SQL = TOK_SQL + """, pq as (select term, 1.0 + sum(case when quality = 1 then tf else 0 end) as p, 1.0 + sum(case when quality = 1 then 0 else tf end) as q from tf group by term),
ratio as (select term, ln((p / (select sum(p) from pq)) / (q / (select sum(q) from pq))) as r from pq)"""


@query("log_count_ratios", "TX-11", f"with {RATIO_SQL} select term, round(r, 6) as r from ratio")
def log_count_ratios(spark, sf):
    docs = labelled_documents(spark, sf)
    return text.log_count_ratio(word_cells(spark, sf), "quality", 1, 1.0, docs).withColumn("r", F.round("r", 6))


@query("both_ends_of_ratios", "SO-4", f"""
with {RATIO_SQL}, r9 as (select term, round(r, 9) as r from ratio)
select term, r from (select term, r from r9 order by r, term limit 50) union select term, r from (select term, r from r9 order by r desc, term desc limit 50)""")
def both_ends_of_ratios(spark, sf):
    ratios = text.log_count_ratio(word_cells(spark, sf), "quality", 1, 1.0, labelled_documents(spark, sf))
    return text.both_ends(ratios.withColumn("r", F.round("r", 9)), 100)


@query("ratio_weighted_terms", "TX-12", f"""
with {RATIO_SQL}, ends as (select term, r from (select term, r from ratio order by r, term limit 50) union select term, r from (select term, r from ratio order by r desc, term desc limit 50))
select doc_id, term, round(tf * r, 6) as weight from tf join ends using (term)""")
def ratio_weighted_terms(spark, sf):
    docs = labelled_documents(spark, sf).select("doc_id", "text", "quality")
    chosen = text.LogRatioSelector("doc_id", "text", "quality", alpha=1.0, nr_selected=100, pos_label=1).fit(docs)
    return chosen.transform(docs).withColumn("weight", F.round("weight", 6))


@query("stacked_text_columns", "TX-15", f"""
with {LOG_SQL}, w as (select case_id, coalesce(max(case when event_nr = 1 then txt end), '') as e1, coalesce(max(case when event_nr = 2 then txt end), '') as e2 from log where event_nr <= 2 group by case_id),
s as (select case_id, 1 as event, e1 as text from w union all select case_id, 2, e2 from w)
select case_id, max(case when event = 1 then length(text) end)::double as len1_event1, max(case when event = 2 then length(text) end)::double as len1_event2 from s group by case_id""")
def stacked_text_columns(spark, sf):
    wide = order_log(spark, sf).filter("event_nr <= 2").groupBy("case_id").agg(
        *[F.max(F.when(F.col("event_nr") == n, F.col("txt"))).alias(f"txt_event{n}") for n in (1, 2)])
    stacked = text.stack_texts(wide, "case_id", ["txt_event1", "txt_event2"])
    block = stacked.withColumn("v", F.array(F.length("text").cast("double")))
    return text.side_by_side(block, "case_id", "v", 1, 2, "len")
