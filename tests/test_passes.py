"""How often the rows of a log are read: fits and timed runs must not make the same rows again for every pass."""

from pyspark.sql import functions as F

from caselog.operators import encoders, experiments, ranks
from caselog.operators.models import LogSpec, OutcomeModel, PreparedLog, prepare
from caselog.operators.prefixes import select_features

SPEC = LogSpec(static_cols=("amount",), dynamic_cols=("cost",), event_col="act")
FOREST = {"n_estimators": 3, "max_depth": 3}


def small_log(spark, cases=40):
    rows = [(c, n, 3, c % 2, float(c), float(c * n % 7), "ab"[(c + n) % 2]) for c in range(cases) for n in range(1, 4)]
    return spark.createDataFrame(rows, "case_id long, event_nr int, case_length int, label int, amount double, cost double, act string")


def counted(df, column, seen):
    """``df`` with an accumulator that counts how often ``column`` is made."""
    def add(x):
        seen.add(1)
        return x

    kind = dict(df.dtypes)[column]
    return df.withColumn(column, F.udf(add, kind).asNondeterministic()(column))


def test_a_fit_makes_its_vectors_once(spark):
    log = small_log(spark)
    codes = encoders.fit_codes(log, SPEC)
    data = prepare(log, SPEC, 2, codes)
    chosen = select_features(data.rows, SPEC, 2)[0]
    for method, options in [("rf", FOREST), ("logit", {"max_iter": 5})]:
        seen = spark.sparkContext.accumulator(0)
        watched = PreparedLog(counted(data.rows, "case_length", seen), data.log, 2, selection=chosen)
        OutcomeModel(2, SPEC, method, dict(options)).fit_prepared(watched, codes)
        assert seen.value == 40, method


def test_timed_runs_read_the_test_log_once(spark):
    log, seen = small_log(spark), spark.sparkContext.accumulator(0)
    test = counted(log, "cost", seen)
    assert experiments.timed_runs(log, test, SPEC, iterations=2, cls_options=FOREST).count() == 6
    assert seen.value == 120


def test_no_projection_scores_two_prefixes(spark):
    log = small_log(spark)
    m = experiments.CaseMonitor(SPEC, cls_options=FOREST).train(log)
    plan = m.score(log)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan
    assert m.score(log).count() == 120


def test_case_rows_with_gaps_and_repeated_numbers(spark):
    """Slots, ends and counts of cases whose events are not numbered 1, 2, ..."""
    rows = [(1, 1, 1, 1.0, 2.0, "x"), (1, 1, 1, 1.0, 3.0, "y"), (1, 3, 1, 1.0, 4.0, "x"), (2, 2, 0, 1.0, 5.0, "z"), (3, 1, 0, 1.0, 0.0, "x"), (3, 2, 0, 1.0, 6.0, None),
            (4, 5, 0, 1.0, 7.0, "x")]
    log = spark.createDataFrame(rows, "case_id long, event_nr int, label int, amount double, cost double, act string")
    found = {r["case_id"]: r for r in prepare(log, SPEC, 4, {}).rows.collect()}
    assert {c: r["ends"] for c, r in found.items()} == {1: [2, 2, 3, 3], 2: [0, 1, 1, 1], 3: [1, 2, 2, 2], 4: [0, 0, 0, 0]}
    assert found[1]["numbers"][1:] == [0.0, 4.0, 0.0] and found[1]["numbers"][0] in (2.0, 3.0)
    assert (found[2]["numbers"], found[3]["numbers"], found[4]["numbers"]) == ([0.0, 5.0, 0.0, 0.0], [0.0, 6.0, 0.0, 0.0], [0.0] * 4)
    chosen = select_features(prepare(log, SPEC, 4, {}).rows, SPEC, 4)[0]
    assert chosen.categories[1] == ["event1_x", "event1_y"] and chosen.numbers[1] == [0]
    assert chosen.categories[2] == ["event1_x", "event1_y", "event2_MISSING", "event2_z"] and chosen.numbers[2] == [0, 1]


def test_hot_keys_share_a_bucket(spark, monkeypatch):
    """Keys of one bucket are told apart, null is a key like others, and no key is counted where no bucket is full."""
    rows = spark.range(1000).select(F.when(F.col("id") < 300, F.lit("hot")).when(F.col("id") < 500, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    monkeypatch.setattr(ranks, "HOT_BUCKETS", 1)
    assert {r["k"]: r["_total"] for r in ranks.hot_keys(rows, "k", 150).collect()} == {"hot": 300, None: 200}
    assert ranks.hot_keys(rows, "k", 400) is None
