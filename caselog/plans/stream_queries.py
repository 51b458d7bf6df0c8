"""Streamed monitoring of the user log; the answers must equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.plans.logs import USER_SQL, table
from caselog.plans.registry import query
from caselog.session import durable, remove_folder
from caselog.sources.files import shared_folder
from caselog.streaming import cases

RUN_SQL = USER_SQL + """, run as (select *, sum(value) over (partition by case_id order by event_nr) as so_far from ulog),
scored as (select *, so_far / (20.0 * event_nr) as score from run)"""


DELAY_MS = 3600 * 1000


def watched(spark, sf, emit):
    """The events as a stream that ends: a last row without a case moves the watermark to the latest event, so that nothing is held back."""
    events = table(spark, sf, "events")
    folder = shared_folder(spark, "stream")
    end = events.agg((F.max("ts").cast("timestamp") + F.expr(f"interval {DELAY_MS // 1000} seconds")).alias("ts"))
    end.select(*[F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(f"{folder}/end")
    # a glob, since a plain path has to be a folder here
    given = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet")
    stream = given.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/end")).withColumn(
        "case_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")))
    out = cases.watch_cases(stream, "case_id", "ts", "event_id", "value", 20.0, 0.6, delay_ms=DELAY_MS, emit=emit)
    cases.run_available(out, f"{folder}/out", f"{folder}/progress")
    found = durable(spark.read.schema(cases.OUTPUT).parquet(f"{folder}/out"))
    remove_folder(spark, folder)
    return found


@query("streamed_prefixes", "SM-1", f"""
with {RUN_SQL} select case_id, event_id, cast(event_nr as integer) as event_nr, round(so_far, 6) as so_far from scored""")
def streamed_prefixes(spark, sf):
    return watched(spark, sf, (cases.PREFIX,)).select("case_id", "event_id", "event_nr", F.round("so_far", 6).alias("so_far"))


@query("streamed_alerts", "SM-2", f"""
with {RUN_SQL} select case_id, min(event_nr)::integer as event_nr from scored where score >= 0.6 group by case_id""")
def streamed_alerts(spark, sf):
    return watched(spark, sf, (cases.ALERT,)).select("case_id", "event_nr")


@query("streamed_closings", "SM-3", f"""
with {RUN_SQL}, c as (select case_id, max(ts) as last_ts, max(score) as top, max(event_nr) as n from scored group by case_id)
select case_id, cast(n as integer) as event_nr from c
where top < 0.6 and epoch_ms(last_ts) + 86400000 < (select epoch_ms(max(ts)) from events) - 3600000""")
def streamed_closings(spark, sf):
    return watched(spark, sf, (cases.CLOSED,)).select("case_id", "event_nr")
