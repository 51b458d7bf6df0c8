"""Event logs read from the given tables.

The order log: lines are events, orders are cases. The user log: events of
a user on one day are a case. Labelled documents carry the long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.operators.events import number_events
from caselog.operators.ranks import HOT_ROWS, hot_keys, running_in_case

LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

TEXT_BYTES = 8 << 20  # text of one task

_known_hot: dict = {}
_text_bytes: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hot(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, key: str):
    """Hot cases of a table, looked up once per session and folder."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _known_hot:
        _known_hot[slot] = hot_keys(df, key, HOT_ROWS)
    return _known_hot[slot]


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines: one shuffle by order. Cases above HOT_ROWS lines are cut by day and line number."""
    lines = table(spark, sf_dir, "lineitem")
    hot = _hot(spark, sf_dir, "lineitem", lines, "l_orderkey")
    numbered = number_events(lines, "l_orderkey", [F.col(c) for c in LINE_ORDER], F.struct("l_shipdate", "l_linenumber"), hot=hot)
    return numbered.withColumnRenamed("l_orderkey", "case_id")


def order_log(spark: SparkSession, sf_dir: str, parts: bool = True, events: DataFrame | None = None) -> DataFrame:
    """Numbered lines with the order's outcome and, if asked, the part's category and name."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), "o_totalprice", F.col("o_orderpriority").alias("pr"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    log = (order_events(spark, sf_dir) if events is None else events).join(orders, "case_id")
    columns = ["case_id", "event_nr", "case_length", F.col("l_shipdate").alias("ts"), "l_quantity", "l_extendedprice",
               F.col("l_returnflag").alias("act"), "o_totalprice", "pr", "label"]
    if parts:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("cat"), F.col("p_name").alias("txt"))
        log = log.join(part, F.col("l_partkey") == F.col("p_partkey"))
        columns += ["cat", "txt"]
    return log.select(*columns, *([] if events is None else ["score"]))


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order log with a rule score per prefix: mean quantity so far over 50.

    The running sum uses the numbering's own window, before any join, so the
    lines are sorted once.
    """
    events = order_events(spark, sf_dir)
    hot = _known_hot[(spark.sparkContext.applicationId, sf_dir, "lineitem")]
    running = running_in_case(events, "case_id", "event_nr", {"so_far": ("sum", "l_quantity")}, None if hot is None else HOT_ROWS,
                              [F.col(c) for c in LINE_ORDER])
    scored = running.withColumn("score", F.col("so_far") / (F.lit(50.0) * F.col("event_nr")))
    return order_log(spark, sf_dir, parts=False, events=scored)


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on one day, numbered by time; label: any purchase."""
    events = table(spark, sf_dir, "events").withColumn(
        "case_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")))
    hot = _hot(spark, sf_dir, "events", events, "case_id")
    numbered = number_events(events, "case_id", [F.col("ts"), F.col("event_id")], F.date_trunc("second", "ts"), hot=hot)
    bought = events.groupBy("case_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("label"))
    return numbered.join(bought, "case_id").select(
        "case_id", "event_nr", "case_length", "event_id", "ts", F.col("event_type").alias("act"), "value", "label")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts placed by document: a text is far smaller than its (document, term) rows, and counts and norms per document then
    need no further shuffle.

    A task takes about TEXT_BYTES of text however large the table is, since its rows are some thirty times as large; an
    explicit number of parts also keeps Spark from joining small ones. The bytes are added up once per session and folder.
    """
    docs = table(spark, sf_dir, "documents")
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _text_bytes:
        _text_bytes[slot] = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return docs.repartition(max(spark.sparkContext.defaultParallelism, -(-_text_bytes[slot] // TEXT_BYTES)), "doc_id")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, placed by document."""
    return _placed(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, placed like the labelled ones."""
    return _placed(spark, sf_dir)


# The same logs in SQL, for the checks.
EVENTS_SQL = """events_log as (
  select *, l_orderkey as case_id,
    row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey,
      l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as event_nr,
    count(*) over (partition by l_orderkey) as case_length
  from lineitem)"""
LOG_SQL = EVENTS_SQL + """, log as (
  select case_id, event_nr, case_length, l_shipdate as ts, l_quantity, l_extendedprice, l_returnflag as act,
    p_type as cat, p_name as txt, o_totalprice, o_orderpriority as pr,
    case when o_orderstatus = 'F' then 1 else 0 end as label
  from events_log join orders on case_id = o_orderkey join part on l_partkey = p_partkey)"""
SCORES_SQL = LOG_SQL + """, scores as (
  select *, sum(l_quantity) over (partition by case_id order by event_nr) / (50.0 * event_nr) as score from log)"""
USER_SQL = """user_days as (
  select *, cast(user_id as varchar) || '_' || cast(cast(ts as date) as varchar) as case_id from events),
ulog as (
  select case_id, row_number() over (partition by case_id order by ts, event_id) as event_nr,
    count(*) over (partition by case_id) as case_length, event_id, ts, event_type as act, value,
    max(case when event_type = 'purchase' then 1 else 0 end) over (partition by case_id) as label
  from user_days)"""
DOCS_SQL = "docs as (select * from documents join labels using (doc_id))"
ALL_DOCS_SQL = "docs as (select * from documents)"
CASES_SQL = "cases as (select case_id, max(label) as label, max(case_length) as case_length from log group by case_id)"
CONF_SQL = "confs as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as confidence)"
