"""Small frames with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from caselog.functions import scalars as S
from caselog.functions import text as T
from caselog.operators import clean, encode, events, features, metrics, monitor, split, text, tune


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def small_log(spark):
    data = [("A", 1, "x", None, 1, 3), ("A", 2, None, 10.0, 1, 3), ("A", 3, "y", 20.0, 1, 3), ("B", 1, "x", 5.0, 0, 1),
            ("C", 1, "z", 1.0, 1, 2), ("C", 2, "x", None, 1, 2)]
    return spark.createDataFrame(data, "case_id string, event_nr int, cat string, amt double, label int, case_length int")


def test_one_hot_and_dynamic(small_log):
    cells = encode.category_cells(small_log.filter("case_length >= 2"), "case_id", "event_nr", 2, None, ["cat"])
    vocab = encode.vocabulary(cells, "event_nr")
    assert rows(vocab, "event_nr", "value", "idx") == [(1, "x", 0), (1, "z", 1), (2, "MISSING", 0), (2, "x", 1)]
    wide = encode.wide_one_hot(small_log, "case_id", "event_nr", [("cat", 1, "x"), ("cat", 1, "z"), ("cat", 2, "MISSING"), ("cat", 2, "x")])
    assert rows(wide, "case_id", "cat_event1_x", "cat_event1_z", "cat_event2_MISSING", "cat_event2_x") == [("A", 1, 0, 1, 0), ("C", 0, 1, 0, 1)]
    numbers = encode.wide_numbers(small_log, "case_id", "event_nr", 2, ["amt"], keep_short=True)
    assert rows(numbers, "case_id", "amt_event1", "amt_event2") == [("A", 0, 10), ("B", 5, 0), ("C", 1, 0)]


def test_unseen_value_gives_zeros(small_log):
    wide = encode.wide_one_hot(small_log.withColumn("cat", F.lit("w")), "case_id", "event_nr", [("cat", 1, "x"), ("cat", 1, "z")], keep_short=True)
    assert {(r["cat_event1_x"], r["cat_event1_z"]) for r in wide.collect()} == {(0.0, 0.0)}


def test_static_and_last_state(small_log):
    assert rows(encode.static_block(small_log, "case_id", "event_nr", ["amt"]), "case_id", "amt") == [("A", 10), ("B", 5), ("C", 1)]
    within = {r["case_id"]: r["amt"] for r in encode.static_block(small_log, "case_id", "event_nr", ["amt"], 1).collect()}
    assert within == {"A": None, "B": 5.0, "C": 1.0}
    last = small_log.filter("event_nr <= 2")
    assert rows(events.last_state(last, "case_id", "event_nr", ["cat"]), "case_id", "cat") == [("A", "x"), ("B", "x"), ("C", "x")]


SCORES = [("A", 1, .2, 1, 3), ("A", 2, .7, 1, 3), ("A", 3, .5, 1, 3), ("B", 1, .6, 0, 1), ("C", 1, .1, 1, 2), ("C", 2, .3, 1, 2),
          ("D", 1, .4, 0, 2), ("D", 2, .59, 0, 2)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "case_id string, event_nr int, score double, label int, case_length int")


def test_first_crossing_and_metrics(scores):
    decided = monitor.decisions(scores, "case_id", "event_nr", [0.6, 0.9])
    assert rows(monitor.alerts(decided), "confidence", "case_id", "nr_events") == [(0.6, "A", 2), (0.6, "B", 1)]
    m = {r["confidence"]: r for r in monitor.evaluate(decided, 1).collect()}
    got = m[0.6]
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (1, 1, 1, 1)
    for name in ("recall", "precision", "accuracy", "f1", "specificity", "failure_rate"):
        assert got[name] == pytest.approx(0.5)
    assert got["earliness"] == pytest.approx((2 / 3 + 1) / 2) and got["mean_nr_events"] == 1.5
    assert all(m[0.9][n] == 0 for n in ("recall", "precision", "accuracy", "f1", "earliness"))
    event = {r["confidence"]: r for r in monitor.evaluate(decided, 1, unit="event").collect()}[0.6]
    assert (event["tn"], event["fn"]) == (2, 2)
    assert event["accuracy"] == pytest.approx(0.5) and event["f1"] == pytest.approx(0.4)


def test_alerts_fall_with_confidence(scores):
    decided = monitor.decisions(scores, "case_id", "event_nr", [0.1, 0.3, 0.5, 0.7])
    per = {r["confidence"]: r["n_alerts"] for r in monitor.evaluate(decided, 1).collect()}
    assert list(per.values()) and [per[c] for c in sorted(per)] == sorted(per.values(), reverse=True)


def test_two_sided_tie_gives_two_rows(spark):
    s = spark.createDataFrame([("A", 1, .5, .5, 1, 1)], "case_id string, event_nr int, p1 double, p0 double, label int, case_length int")
    assert monitor.two_sided_alerts(s, "case_id", "event_nr", [0.5], {1: "p1", 0: "p0"}).count() == 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d1", "aa bb", 1), ("d2", "aa", 1), ("d3", "bb cc", 0), ("d4", "cc", 0)], "doc string, text string, y int")


def test_text_scores(docs):
    cells = text.term_counts(docs, "doc", T.words("text"), ["y"])
    chi = text.chi_square(cells, "y", "tf", text.class_shares(docs, "y"))
    assert rows(chi, "term", "chi2") == [("aa", 2), ("bb", 0), ("cc", 2)]
    assert [r["term"] for r in text.top_terms(chi, "chi2", 2).collect()] == ["aa", "cc"]
    w = text.tfidf(cells, "doc", text.document_frequencies(cells), 4)
    got = {(r["doc"], r["term"]): round(r["weight"], 6) for r in w.collect()}
    assert got[("d1", "aa")] == got[("d1", "bb")] == 0.707107 and got[("d2", "aa")] == 1
    ratio = text.log_count_ratio(cells, "y", 1, 1.0, docs)
    assert {r["term"]: round(r["r"], 6) for r in ratio.collect()} == {"aa": 1.098612, "bb": 0.0, "cc": -1.098612}
    assert rows(text.both_ends(ratio, 2), "term") == [("aa",), ("cc",)]
    with pytest.raises(ValueError):
        text.both_ends(ratio, 1)


def test_one_class_counts_as_one(docs):
    only = docs.filter("y = 1")
    r = text.log_count_ratio(text.term_counts(only, "doc", T.words("text"), ["y"]), "y", 1, 1.0, only)
    assert {x["term"]: round(x["r"], 6) for x in r.collect()} == {"aa": round(math.log(3 / 5), 6), "bb": round(math.log(2 / 5), 6)}


def test_short_tokens_disappear(spark):
    d = spark.createDataFrame([("A b 0 über x1",)], "text string")
    assert d.select(T.words("text")).first()[0] == ["über", "x1"]


def test_ngrams(spark):
    d = spark.createDataFrame([(["a1", "b1", "c1"],), (["a1"],), ([],)], "t array<string>")
    got = [r[0] for r in d.select(T.ngrams("t", 1, 3)).collect()]
    assert got == [["a1", "b1", "c1", "a1 b1", "b1 c1", "a1 b1 c1"], ["a1"], []]


def test_auc(spark):
    d = spark.createDataFrame([(1, .8), (0, .8), (1, .6), (0, .2)], "y int, s double")
    assert metrics.roc_auc(d, "s", F.col("y") == 1).first()["auc"] == 0.625
    assert metrics.roc_auc(d.filter("y = 1"), "s", F.col("y") == 1).first()["auc"] is None


def test_cleaning(spark):
    d = spark.createDataFrame([("TRUE", " 1.5 ", "31.12.2016 23:59"), ("False", "x", "zz"), ("yes", None, None), (None, "1.5d", None)],
                              "b string, n string, t string")
    got = d.select(S.text_flag("b").alias("b"), S.number_or_zero("n").alias("n"),
                   S.epoch_seconds(S.lenient_timestamp("t", "dd.MM.yyyy HH:mm")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(1, 1.5, 1483228740), (0, 0.0, None), (0, 0.0, None), (0, 0.0, None)]
    z = clean.zscore(spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "c double, x double"), ["c", "x"])
    assert rows(z, "c", "x") == [(3.0, pytest.approx(-0.707107, abs=1e-6)), (3.0, pytest.approx(0.707107, abs=1e-6))]
    r = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "a double, b double").select(S.ratio("a", "b").alias("r"))
    assert rows(r, "r") == [(0.0,), (0.0,)]


def test_rare_categories(spark):
    values = ["Car"] * 195 + ["Business goal", "Boat", "Home", "Home", None]
    log = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "case_id int, event_nr int, goal string")
    fitted = encode.RareCategories("goal").fit(log, "case_id", "event_nr")
    assert rows(fitted.mapping, "value", "replacement") == [("Boat", "Vehicle Other"), ("Business goal", "Business")]
    new = spark.createDataFrame([(1, "Boat"), (2, "Never seen"), (3, "Car"), (4, None)], "case_id int, goal string")
    assert [r["goal"] for r in fitted.transform(new, "case_id").orderBy("case_id").collect()] == ["Vehicle Other", "Never seen", "Car", None]


def test_result_names(spark):
    names = ["bong_selected100_tfidf_ngram2_rf_part1", "bong_selected100_ngram1_rf_part1", "nb_selected500_alpha0.5_ngram1_logit_part3",
             "lda_k50_tfidf_rf_part2", "pv_size10_window9_rf_part4", "optimal_params_rf"]
    got = {r["name"]: r for r in tune.parse_names(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert set(got) == set(names[:5])
    a = got[names[0]]
    assert (a["family"], a["selected"], a["tfidf"], a["ngram"], a["cls"], a["part"]) == ("bong", "100", "tfidf", "2", "rf", "1")
    assert got[names[1]]["tfidf"] == "no-tfidf" and got[names[2]]["alpha"] == "0.5"
    assert got[names[3]]["k"] == "50" and (got[names[4]]["size"], got[names[4]]["window"]) == ("10", "9")


def test_class_weights_and_balance(spark):
    d = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "k int, y int")
    w = {r["y"]: round(r["weight"], 6) for r in features.class_weights(d, "y").collect()}
    assert w == {1: 0.666667, 0: 2.0}
    assert split.balance_down(d, "k", "y").groupBy("y").count().filter("count <> 1").count() == 0
    assert {r["y"]: r["count"] for r in split.oversample(d, "k", "y", 0).groupBy("y").count().collect()} == {1: 3, 0: 3}


def test_published_identities(spark):
    """Counts and rates of a published run at confidence 0.5: tp 58, fp 64, fn 28, 2805 cases."""
    c = spark.createDataFrame([(0.5, 58, 64, 2655, 28, 86, 122, 2805)],
                              "confidence double, tp long, fp long, tn long, fn long, positives long, n_alerts long, n_cases long")
    r = monitor.with_rates(c).first()
    assert [round(r[x], 4) for x in ("f1", "precision", "recall", "accuracy", "specificity", "failure_rate")] == [
        0.5577, 0.4754, 0.6744, 0.9672, 0.9765, 0.9565]


def test_published_hard_labels(spark):
    rows_ = [(1, 1)] * 357 + [(0, 0)] * 438 + [(0, 1)] * 163 + [(1, 0)] * 244
    d = spark.createDataFrame(rows_, "y int, p int")
    assert metrics.accuracy(d, "y", "p").first()[0] == pytest.approx(0.661398, abs=1e-6)
    assert metrics.hard_auc(d, "y", "p", 1).first()[0] == pytest.approx(0.661398, abs=1e-6)


def test_duplicates_are_refused(spark):
    d = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y")], "c string, n int, v string")
    with pytest.raises(ValueError):
        events.require_unique_events(d, "c", "n")
    assert events.keep_first_event(d, "c", "n", ["v"]).first()["v"] == "x"
