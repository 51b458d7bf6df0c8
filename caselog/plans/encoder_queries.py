"""What fitted models see: the entries of their vectors, by encoding method, in SQL. Fitted on the training side, shown on the test side."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators.models import LogSpec, PrefixVectorizer
from caselog.plans import model_queries as Q
from caselog.plans.logs import LOG_SQL
from caselog.plans.registry import query
from caselog.plans.text_queries import WORDS

K = 2
SIDES_SQL = LOG_SQL + """, goals as (select *, case when cat like 'STANDARD%' then 'STANDARD' when cat like '%STEEL' then cat || ' for Business'
    when cat like '%TIN' then cat || ' boat TAX' when cat like '%COPPER' then 'Debt ' || cat else cat end as goal from log),
sides as (select *, cast('0x' || substr(md5(cast(case_id as varchar) || '_22'), 1, 8) as bigint) / 4294967296.0 < 0.8 as is_train from goals),
train as (select * from sides where is_train)"""
UPTO_SQL = f"upto as (select * from sides where case_length >= {K} and event_nr <= {K}), last as (select * from upto where event_nr = {K})"


def codes_sql(column: str) -> str:
    return f"{column}_codes as (select {column}, row_number() over (order by {column}) as code from (select distinct {column} from train where {column} is not null))"


def kept_sql(cells: str, always: tuple[str, ...] = ()) -> str:
    """Test cells of the features that reach the share in the training cases of the prefix, and of those always kept."""
    named = "".join(f" or feature = '{a}'" for a in always)
    return f"""cells as ({cells}),
kept as (select feature from cells where is_train and number <> 0 group by feature
  having count(*) >= 0.01::double * (select count(distinct case_id) from upto where is_train))
select case_id, feature, number::double as number from cells where not is_train and number <> 0 and (feature in (select feature from kept){named})"""


def model_cells(spark, sf, spec: LogSpec, **texts):
    """Vector entries of the test side from a vectorizer fitted on the training side."""
    goal = (F.when(F.col("cat").like("STANDARD%"), "STANDARD").when(F.col("cat").like("%STEEL"), F.concat("cat", F.lit(" for Business")))
            .when(F.col("cat").like("%TIN"), F.concat("cat", F.lit(" boat TAX"))).when(F.col("cat").like("%COPPER"), F.concat(F.lit("Debt "), "cat")).otherwise(F.col("cat")))
    train, test = (side.withColumn("goal", goal) for side in Q.sides(spark, sf))
    return PrefixVectorizer(spec, K, **texts).fit(train).cells(test)


@query("ordinal_model_cells", "EN-11 EN-8 EN-6 EN-12 MO-3", f"""
with {SIDES_SQL}, {UPTO_SQL}, {codes_sql('cat')}, {codes_sql('act')}, {codes_sql('txt')}, """ + kept_sql("""
  select case_id, is_train, 'cat_event' || event_nr as feature, coalesce(code, 0)::double as number from upto left join cat_codes using (cat)
  union all select case_id, is_train, 'event' || event_nr, coalesce(code, 0) from upto left join act_codes using (act)
  union all select case_id, is_train, 'l_quantity_event' || event_nr, l_quantity from upto
  union all select case_id, is_train, 'act_last', coalesce(code, 0) from last left join act_codes using (act)
  union all select case_id, is_train, 'txt_last', coalesce(code, 0) from last left join txt_codes using (txt)"""))
def ordinal_model_cells(spark, sf):
    """Ordinal codes of each event and of the last state."""
    spec = LogSpec(dynamic_cols=("l_quantity",), cat_cols=("cat",), event_col="act", encoding_method="ordinal", last_state_cols=("act", "txt"))
    return model_cells(spark, sf, spec)


@query("label_model_cells", "EN-11 EN-3 EN-8 EN-12", f"""
with {SIDES_SQL}, {UPTO_SQL}, {codes_sql('pr')}, {codes_sql('act')}, """ + kept_sql("""
  select case_id, is_train, 'o_totalprice' as feature, o_totalprice as number from last
  union all select case_id, is_train, 'pr', coalesce(code, (select count(*) from pr_codes) + 1) from last left join pr_codes using (pr)
  union all select case_id, is_train, 'act_last', coalesce(code, 0) from last left join act_codes using (act)
  union all select case_id, is_train, 'l_quantity_last', l_quantity from last""", ("o_totalprice", "pr")))
def label_model_cells(spark, sf):
    """Static values and last states only."""
    spec = LogSpec(static_cols=("o_totalprice", "pr"), dynamic_cols=("l_extendedprice",), cat_cols=("cat",), event_col="act", encoding_method="label",
                   last_state_cols=("act", "l_quantity"))
    return model_cells(spark, sf, spec)


@query("last_state_model_cells", "EN-8 EN-5 EN-12", f"""
with {SIDES_SQL}, {UPTO_SQL}, """ + kept_sql("""
  select case_id, is_train, 'event' || event_nr || '_' || act as feature, 1.0::double as number from upto
  union all select case_id, is_train, 'act_last_' || act, 1 from last
  union all select case_id, is_train, 'cat_last_' || cat, 1 from last
  union all select case_id, is_train, 'l_quantity_last', l_quantity from last"""))
def last_state_model_cells(spark, sf):
    """One-hot events with the last state's categories and number beside them."""
    return model_cells(spark, sf, LogSpec(event_col="act", last_state_cols=("act", "cat", "l_quantity")))


@query("rare_group_model_cells", "EN-1 EN-2 EN-4 EN-12", f"""
with {SIDES_SQL}, firsts as (select case_id, min_by(goal, event_nr) as value from train group by case_id),
rare as (select value, case when lower(value) like '%business%' then 'Business' when lower(value) like '%boat%' then 'Vehicle Other'
    when lower(value) like '%debt%' then 'Debt Management' when lower(value) like '%tax%' then 'Tax and Payments' else 'Other' end as replacement
  from firsts group by value having count(*) / (select count(*) from firsts) < 0.01::double),
{UPTO_SQL}, """ + kept_sql("""
  select case_id, is_train, 'goal_event' || event_nr || '_' || coalesce(replacement, goal) as feature, 1.0::double as number from upto left join rare on goal = value"""))
def rare_group_model_cells(spark, sf):
    """One-hot categories after the training side's rare values went to their groups."""
    return model_cells(spark, sf, LogSpec(cat_cols=("goal",), rare_cols=("goal",)))


def best_sql(column: str) -> str:
    """The 20 best terms of the last texts of one column, by the training side's labels."""
    return f"""{column}_tf as (select case_id, label, is_train, term, count(*) as tf from (
  select case_id, label, is_train, unnest({WORDS.replace('text', column)}) as term from last) group by all),
{column}_tot as (select term, sum(tf)::double as t from {column}_tf where is_train group by term),
{column}_obs as (select term, label, sum(tf)::double as o from {column}_tf where is_train group by all),
{column}_best as (select term from (select term, sum((coalesce(o, 0) - s * t) * (coalesce(o, 0) - s * t) / (s * t)) as chi2
  from {column}_tot cross join share left join {column}_obs using (term, label) group by term) order by chi2 desc, term limit 20)"""


@query("two_text_model_cells", "TX-15 TX-10 MO-2 EN-12", f"""
with {SIDES_SQL}, {UPTO_SQL}, share as (select label, count(*) / (select count(*) from last where is_train)::double as s from last where is_train group by label),
{best_sql('txt')}, {best_sql('goal')}
select case_id, 'txt=' || term as feature, tf::double as number from txt_tf where not is_train and term in (select term from txt_best)
union all select case_id, 'goal=' || term, tf::double from goal_tf where not is_train and term in (select term from goal_best)""")
def two_text_model_cells(spark, sf):
    """Two text columns in one model: each has its own vocabulary and its own best terms."""
    return model_cells(spark, sf, LogSpec(text_cols=("txt", "goal")), text_method="BoNGTransformer", text_options={"nr_selected": 20})
