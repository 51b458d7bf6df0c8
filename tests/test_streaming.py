"""Streaming in several micro-batches equals the batch answer on the same rows."""

from pyspark.sql import functions as F

from caselog.operators import monitor
from caselog.plans.logs import table, user_log
from caselog.streaming import cases


def test_batches_in_time_order(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn(
        "case_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")))
    source = tmp_path / "in"
    bounds = events.selectExpr("percentile(unix_seconds(cast(ts as timestamp)), array(0.25, 0.5, 0.75))").first()[0]
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    edges = [float("-inf"), *bounds, float("inf")]
    for i in range(4):
        part = events.filter((second > edges[i]) & (second <= edges[i + 1])) if i else events.filter(second <= edges[1])
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = cases.watch_cases(stream, "case_id", "ts", "event_id", "value", 20.0, 0.6, emit=(cases.PREFIX, cases.ALERT), hold=False)
    query = cases.run_available(out, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 4
    got = spark.read.schema(cases.OUTPUT).parquet(str(tmp_path / "out"))

    log = user_log(spark, sf_dir)
    assert {(r["event_id"], r["event_nr"]) for r in got.filter("kind = 'prefix'").collect()} == {
        (r["event_id"], r["event_nr"]) for r in log.collect()}
    from pyspark.sql import Window

    w = Window.partitionBy("case_id").orderBy("event_nr")
    scores = log.withColumn("score", F.sum("value").over(w) / (20.0 * F.col("event_nr")))
    fired = monitor.alerts(monitor.decisions(scores, "case_id", "event_nr", [0.6]))
    assert {(r["case_id"], r["event_nr"]) for r in got.filter("kind = 'alert'").collect()} == {
        (r["case_id"], r["nr_events"]) for r in fired.collect()}


def watched(spark, tmp_path, batches, **options):
    """Rows of (case_id, second, event_id, value), one micro-batch per list; (case, kind, number, event, sum) of the answer."""
    source = tmp_path / "in"
    for part in batches:
        rows = spark.createDataFrame(part, "case_id string, s long, event_id long, value double").withColumn("ts", F.timestamp_seconds("s"))
        rows.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = cases.watch_cases(stream, "case_id", "ts", "event_id", "value", 10.0, 0.8, emit=(cases.PREFIX, cases.ALERT, cases.CLOSED), **options)
    cases.run_available(out, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.schema(cases.OUTPUT).parquet(str(tmp_path / "out"))
    return sorted((r["case_id"], r["kind"], r["event_nr"], r["event_id"] or 0, r["so_far"]) for r in got.collect())


DAY = 24 * 3600


def test_a_closed_case_keeps_its_mark(spark, tmp_path):
    batches = [[("a", 1000, 1, 1.0)], [("z", 1000 + 3 * DAY, 2, 1.0)], [("z", 1010 + 3 * DAY, 3, 1.0)],
               [("a", 1020 + 3 * DAY, 4, 90.0)], [("z", 1030 + 3 * DAY, 5, 1.0)]]
    got = [r for r in watched(spark, tmp_path, batches, hold=False) if r[0] == "a"]
    assert got == [("a", "closed", 1, 0, 1.0), ("a", "prefix", 1, 1, 1.0), ("a", "prefix", 2, 4, 91.0)]


def test_an_alerted_case_alerts_once_after_a_gap(spark, tmp_path):
    batches = [[("a", 1000, 1, 9.0)], [("z", 1000 + 3 * DAY, 2, 1.0)], [("z", 1010 + 3 * DAY, 3, 1.0)], [("a", 1020 + 3 * DAY, 4, 9.0)]]
    got = [r for r in watched(spark, tmp_path, batches, hold=False) if r[0] == "a"]
    assert got == [("a", "alert", 1, 1, 9.0), ("a", "prefix", 1, 1, 9.0), ("a", "prefix", 2, 4, 18.0)]


def test_held_events_are_numbered_in_time_order(spark, tmp_path):
    batches = [[("a", 3000, 3, 1.0), ("b", 2000, 6, 1.0)], [("a", 1000, 1, 9.0), ("b", 2100, 7, 9.0)], [("a", 2000, 2, 1.0)],
               [("z", 5 * DAY, 9, 1.0)], [("z", 5 * DAY + 10, 10, 1.0)]]
    got = [r for r in watched(spark, tmp_path, batches, hold=True) if r[0] != "z"]
    assert got == [("a", "alert", 1, 1, 9.0), ("a", "prefix", 1, 1, 9.0), ("a", "prefix", 2, 2, 10.0), ("a", "prefix", 3, 3, 11.0),
                   ("b", "closed", 2, 0, 10.0), ("b", "prefix", 1, 6, 1.0), ("b", "prefix", 2, 7, 10.0)]


def test_a_gap_closes_a_held_case_before_the_later_event(spark, tmp_path):
    batches = [[("a", 3 * DAY, 2, 90.0), ("a", 3 * DAY - 100, 1, 1.0)], [("a", 5 * DAY, 3, 9.0)], [("z", 9 * DAY, 9, 1.0)], [("z", 9 * DAY + 10, 10, 1.0)]]
    got = [r for r in watched(spark, tmp_path, [[("a", DAY, 8, 1.0)], *batches], hold=True) if r[0] == "a"]
    assert got == [("a", "closed", 1, 0, 1.0), ("a", "prefix", 1, 8, 1.0), ("a", "prefix", 2, 1, 2.0), ("a", "prefix", 3, 2, 92.0), ("a", "prefix", 4, 3, 101.0)]


def test_shuffled_batches_give_the_batch_answer(spark, sf_dir, tmp_path):
    """Events out of order by up to the delay, over ten micro-batches; a last row without a case ends the stream."""
    events = table(spark, sf_dir, "events").withColumn(
        "case_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")))
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    jittered = events.withColumn("_at", second + F.pmod(F.xxhash64("event_id"), F.lit(3500))).toPandas().sort_values("_at").drop(columns="_at")
    source = tmp_path / "in"
    end = jittered.iloc[[-1]].assign(case_id=None, ts=jittered["ts"].max() + __import__("pandas").Timedelta(hours=1))
    cuts = [len(jittered) * i // 10 for i in range(11)]
    for part in [jittered.iloc[a:b] for a, b in zip(cuts, cuts[1:])] + [end]:
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = cases.watch_cases(stream, "case_id", "ts", "event_id", "value", 20.0, 0.6, emit=(cases.PREFIX, cases.ALERT, cases.CLOSED))
    query = cases.run_available(out, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 11
    got = spark.read.schema(cases.OUTPUT).parquet(str(tmp_path / "out"))
    log = user_log(spark, sf_dir)
    assert {(r["event_id"], r["event_nr"]) for r in got.filter("kind = 'prefix'").collect()} == {(r["event_id"], r["event_nr"]) for r in log.collect()}
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held > 0


def test_marks_expire_and_state_goes(spark, tmp_path):
    """A day after the last event a case closes; its mark goes ``keep_ms`` later and the state rows with it."""
    source = tmp_path / "in"
    rows = [[(f"c{i}", 1000 + i, i, 1.0) for i in range(40)], [("z", 3 * DAY, 90, 1.0)], [("z", 3 * DAY + 10, 91, 1.0)],
            [("z", 30 * DAY, 92, 1.0)], [("z", 30 * DAY + 10, 93, 1.0), ("c1", 30 * DAY, 94, 90.0)], [("z", 30 * DAY + 2 * 3600, 95, 1.0)]]
    sizes = []
    for part in rows:
        spark.createDataFrame(part, "case_id string, s long, event_id long, value double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode(
            "append").parquet(str(source))
        stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
        out = cases.watch_cases(stream, "case_id", "ts", "event_id", "value", 10.0, 0.8, emit=(cases.ALERT, cases.CLOSED))
        query = cases.run_available(out, str(tmp_path / "out"), str(tmp_path / "progress"))
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
    got = spark.read.schema(cases.OUTPUT).parquet(str(tmp_path / "out"))
    closed = [r["case_id"] for r in got.filter("kind = 'closed' and case_id <> 'z'").collect()]
    assert sorted(closed) == sorted(f"c{i}" for i in range(40))
    # c1 came back after its mark was gone: a case of its own
    assert [r["event_nr"] for r in got.filter("kind = 'alert' and case_id = 'c1'").collect()] == [1]
    assert sizes[0] >= 40 and sizes[3] < 10, sizes
