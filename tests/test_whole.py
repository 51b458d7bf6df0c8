"""Queries that once stopped short: prefixes, levels, folds, price bands."""

import pytest
from pyspark.sql import functions as F

from caselog.operators import experiments as X
from caselog.operators import monitor
from caselog.plans import encode_queries
from caselog.plans import model_queries as Q
from caselog.plans.registry import load_all


@pytest.fixture()
def small_forest(monkeypatch):
    monkeypatch.setattr(Q, "FOREST", {"n_estimators": 2, "max_depth": 2, "random_state": 22})


def test_every_prefix_that_training_reaches_is_scored(spark, sf_dir, small_forest):
    train, test = Q.sides(spark, sf_dir)
    reach = train.agg(F.max("event_nr")).first()[0]
    want = test.filter(F.col("event_nr") <= reach).select("case_id", "event_nr").distinct().count()
    got = Q.prefix_scores(spark, sf_dir)
    assert reach > 3 and got.count() == got.select("case_id", "nr_events").distinct().count() == want


def test_monitored_metrics_have_all_levels_and_prefixes(spark, sf_dir, small_forest, monkeypatch):
    reached = []
    monkeypatch.setattr(X.CaseMonitor, "test", lambda m, log, levels, **options: (reached.append((max(m.models), list(levels))), (None, None))[1])
    train, _ = Q.sides(spark, sf_dir)
    reach = train.agg(F.max("event_nr")).first()[0]
    Q.monitored_alerts(spark, sf_dir)
    Q.monitored_metrics(spark, sf_dir)
    assert reached == [(reach, list(monitor.CONFIDENCES))] * 2


def test_best_parameters_come_from_five_folds_of_the_training_side(spark, sf_dir, monkeypatch):
    asked, finals = [], []
    found = [(c, m, v, str(part), "rf", d) for c in monitor.CONFIDENCES for m in ("f1", "recall") for part in (1, 2) for d, v in (("3", 0.2), ("5", 0.3 if c < 0.7 else 0.1))]
    table = spark.createDataFrame(found, "confidence double, metric string, value double, part string, cls string, depth string")

    def folds(log, spec, settings, confidences, positive=1, folds=5, max_events=None, seed=22):
        asked.append((log.select("case_id").distinct().count(), list(confidences), folds, max_events))
        return table

    def final(train, test, spec, best, make, **options):
        finals.append(({r["confidence"]: make(r)["cls_options"]["max_depth"] for r in best.collect()}, options.get("max_events")))

    monkeypatch.setattr(X, "cross_validate", folds)
    monkeypatch.setattr(X, "final_run", final)
    train, test = Q.sides(spark, sf_dir)
    n, of_train = train.union(test).select("case_id").distinct().count(), train.select("case_id").distinct().count()
    Q.cross_validated_metrics(spark, sf_dir)
    Q.final_metrics(spark, sf_dir)
    assert asked == [(n, list(monitor.CONFIDENCES), 5, None), (of_train, list(monitor.CONFIDENCES), 5, None)]
    assert finals == [({c: 5 if c < 0.7 else 3 for c in monitor.CONFIDENCES}, None)]


def test_equal_settings_are_trained_once(spark, sf_dir, monkeypatch):
    trained = []
    monkeypatch.setattr(X, "training_data", lambda *a: (None, {}))
    monkeypatch.setattr(X, "train_all", lambda jobs, *a: trained.extend(m.cls_options for m, *_ in jobs))
    monkeypatch.setattr(X.CaseMonitor, "prepared", lambda m, log: None)
    monkeypatch.setattr(X.CaseMonitor, "test_prepared", lambda m, log, levels, **options: (
        None, spark.createDataFrame([(c, "f1", 1.0) for c in levels], "confidence double, metric string, value double")))
    best = spark.createDataFrame([(0.5, "rf", 3), (0.6, "rf", 5), (0.7, "rf", 3)], "confidence double, cls string, depth int")
    out = X.final_run(None, None, Q.SPEC, best, lambda r: {"cls_options": {"max_depth": r["depth"]}})
    assert out.count() == 3 and [t["max_depth"] for t in trained] == [3, 5]


def test_orders_of_every_price_are_on_a_side(spark, monkeypatch):
    rows = [(k, "1-URGENT" if k < 900 else f"x{k}", "F", 5000.0) for k in range(1000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    monkeypatch.setattr(encode_queries, "table", lambda *_: orders)
    got = load_all()["missing_and_extra_features_by_side"].build(spark, "").collect()
    assert sorted(r["feature"] for r in got if r["kind"] != "train features") == sorted(f"x{k}_F" for k in range(900, 1000))
    assert {r["kind"] for r in got} == {"missing", "extra", "train features"}


def test_alerts_with_case_length_have_every_level(spark, sf_dir):
    names = load_all()
    levels = {n: {r["confidence"]: r["count"] for r in names[n].build(spark, sf_dir).groupBy("confidence").count().collect()} for n in ("alerts_with_case_length_all_levels", "first_crossings")}
    assert levels["alerts_with_case_length_all_levels"] == levels["first_crossings"] and min(levels["first_crossings"]) == 0.5


def test_each_prefix_has_its_own_times(spark, sf_dir, small_forest, monkeypatch):
    whole_data = X.training_data
    monkeypatch.setattr(X, "training_data", lambda log, spec, max_events=None: whole_data(log, spec, 2))
    asked = []
    monkeypatch.setattr(X, "timed_runs", lambda *a, whole=X.timed_runs, iterations, **o: (asked.append((iterations, o.get("max_events"))), whole(*a, iterations=2, **o))[1])
    got = Q.timed_prefixes(spark, sf_dir).collect()
    times = ["train_preproc_time", "train_cls_time", "test_encode_time", "test_preproc_time", "test_time"]
    assert asked == [(10, None)] and sorted((r["iteration"], r["nr_events"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r[t] > 0 for r in got for t in times)
    # not one total shared out by case counts
    assert len({round(r["test_time"] / r["nr_test_cases"], 12) for r in got}) == 4
