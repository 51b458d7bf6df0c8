"""Model steps on a log with a planted signal."""

import pytest
from pyspark.sql import functions as F

from caselog.operators import experiments as X
from caselog.operators import metrics
from caselog.operators.models import LogSpec, OutcomeModel, TopicModel, UnitScaler, WordVectors, p_of
from caselog.operators.saved import load_model, save_model

SPEC = LogSpec(static_cols=("amount", "kind"), dynamic_cols=("v",), cat_cols=("cat",), event_col="act", text_col="note")


@pytest.fixture(scope="module")
def log(spark):
    base = spark.range(240).select(F.col("id").alias("case_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3 + 2).cast("int").alias("case_length"))
    rows = base.withColumn("event_nr", F.explode(F.sequence(F.lit(1), "case_length")))
    noise = F.pmod(F.hash("case_id", "event_nr"), F.lit(10))
    return rows.select(
        "case_id", "label", "case_length", "event_nr", (F.col("label") * 8 + noise).cast("double").alias("v"),
        F.when(noise < 5, "x").otherwise("y").alias("cat"), F.when(F.col("event_nr") == 1, "start").otherwise("step").alias("act"),
        (noise * 10).cast("double").alias("amount"), F.when(F.col("case_id") % 5 == 0, "rare").otherwise("usual").alias("kind"),
        F.when((F.col("label") == 1) & (noise < 8), "good news here").otherwise("bad news there").alias("note")).cache()


def quality(model, log):
    rows = model.predict_proba(log).select(F.col("label").alias("y"), p_of(model.classes, 1).alias("p"))
    return metrics.roc_auc(rows, "p", F.col("y") == 1).first()["auc"], rows.count()


@pytest.mark.parametrize("method,options", [("rf", {"n_estimators": 10, "max_depth": 4}), ("logit", {}), ("svm", {"n_components": 64})])
def test_classifiers_find_the_signal(log, method, options):
    auc, n = quality(OutcomeModel(2, SPEC, method, options).fit(log), log)
    assert auc > 0.85 and n == 240


@pytest.mark.parametrize("method,options", [("BoNGTransformer", {"tfidf": True, "nr_selected": 3}), ("NBLogCountRatioTransformer", {"nr_selected": 4, "pos_label": 1})])
def test_text_terms_become_features(log, method, options):
    spec = LogSpec(event_col="act", text_col="note")
    model = OutcomeModel(2, spec, "logit", {}, method, options).fit(log)
    assert any(n.startswith("note=") for n in model.vectorizer.names)
    assert quality(model, log)[0] > 0.8


def test_short_cases(log):
    model = OutcomeModel(3, SPEC, "rf", {"n_estimators": 5, "max_depth": 3}).fit(log)
    assert model.predict_proba(log).count() == 160
    from dataclasses import replace

    kept = OutcomeModel(3, replace(SPEC, keep_short=True), "rf", {"n_estimators": 5, "max_depth": 3}).fit(log)
    assert kept.predict_proba(log).count() == 240


def test_unseen_values_and_events_do_not_fail(log):
    model = OutcomeModel(2, SPEC, "rf", {"n_estimators": 5, "max_depth": 3}).fit(log)
    odd = log.withColumn("cat", F.lit("new")).withColumn("kind", F.lit("new")).withColumn("act", F.lit("new"))
    p = model.predict_proba(odd).select(F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 9).alias("s")).distinct().collect()
    assert [r["s"] for r in p] == [1.0]
    with pytest.raises(ValueError):
        OutcomeModel(2, SPEC).score_prepared(None)


def test_one_class_only(log):
    only = log.filter("label = 1")
    model = OutcomeModel(1, SPEC).fit(only)
    assert {tuple(r["p"]) for r in model.predict_proba(only).collect()} == {(1.0,)}


def test_no_training_case_gives_empty_scores(log):
    model = OutcomeModel(9, SPEC, "rf", {}, "bong", {"nr_selected": 3}).fit(log)
    assert model.classes == [] and model.predict_proba(log).count() == model.predict(log).count() == 0
    assert OutcomeModel(1, SPEC).fit(log.filter("case_id < 0")).predict(log).dtypes == OutcomeModel(1, SPEC).fit(log.filter("label = 1")).predict(log).dtypes


def test_texts_need_no_case_length(log):
    spec = LogSpec(event_col="act", text_col="note")
    options = ("logit", {}, "bong", {"nr_selected": 3})
    bare = log.drop("case_length")
    got = {(r["case_id"], r["case_length"]) for r in OutcomeModel(2, spec, *options).fit(bare).predict(bare).collect()}
    assert got == {(r["case_id"], r["case_length"]) for r in log.select("case_id", "case_length").distinct().collect()}
    assert any(n.startswith("note=") for n in OutcomeModel(2, spec, *options).fit(bare).vectorizer.names)


def test_scaler_uses_the_population_deviation(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "a array<double>").select(array_to_vector("a").alias("f"))
    got = sorted(tuple(r[0]) for r in UnitScaler("f", "s").fit(d).transform(d).select(vector_to_array("s")).collect())
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_topics_sum_to_one_or_zero(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "cc dd"), (3, ""), (4, "aa cc")], "doc int, text string")
    m = TopicModel(num_topics=3, passes=2).fit(docs)
    sums = {r["doc"]: round(sum(r["values"]), 6) for r in m.transform(docs).collect()}
    assert sums == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0}


def test_word_vectors(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "cc dd aa bb")], "doc int, text string")
    assert all(len(r["values"]) == 4 for r in WordVectors(size=4, window=2).fit(docs).transform(docs).collect())


def test_monitor_and_outputs(spark, log, tmp_path):
    m = X.CaseMonitor(SPEC, cls_options={"n_estimators": 5, "max_depth": 3}).train(log, 3)
    assert sorted(m.models) == [1, 2, 3]
    out, perf = str(tmp_path / "m"), str(tmp_path / "p")
    fired, long = m.test(log, [0.5, 0.9], output_filename=out, performance_output_filename=perf)
    per = {r["confidence"]: r["count"] for r in fired.groupBy("confidence").count().collect()}
    assert per[0.5] >= per.get(0.9, 0)
    assert spark.read.option("sep", ";").option("header", True).csv(out).count() == long.count() == 24
    timed = spark.read.option("sep", ";").option("header", True).csv(perf)
    assert sorted((r["nr_events"], r["nr_test_cases"]) for r in timed.collect()) == [("1", "240"), ("2", "240"), ("3", "160")]
    scores = m.score(log)
    assert scores.filter("nr_events > case_length").count() == 0


def test_out_of_fold_predicts_every_case_once(log):
    got = X.out_of_fold(log, SPEC, 1, 3, "rf", {"n_estimators": 3, "max_depth": 2})
    assert got.count() == got.select("case_id").distinct().count() == 240
    with pytest.raises(ValueError):
        X.out_of_fold(log, SPEC, folds="all", row_limit=10)


def test_prefix_models_side_by_side_score_as_alone(log):
    """One case row serves every prefix: no shuffle in the plan, and the scores of models that are made prefix by prefix."""
    m = X.CaseMonitor(SPEC, cls_options={"n_estimators": 5, "max_depth": 3}).train(log)
    data = m.prepared(log)
    scored = m.score_prepared(data)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "from_json" not in plan
    got = {(r["case_id"], r["nr_events"]): r["score"] for r in scored.collect()}
    assert len(got) == log.count()
    for k in (1, 3):
        alone = OutcomeModel(k, SPEC, "rf", {"n_estimators": 5, "max_depth": 3}).fit(log)
        assert alone.vectorizer.names == m.models[k].vectorizer.names
        want = {r["case_id"]: r["p"][1] for r in alone.predict_proba(log).collect()}
        assert want == {c: s for (c, n), s in got.items() if n == k}


def test_features_of_a_fold_are_those_of_its_own_training_part(log):
    """Counts of all cases less the fold's own give what counting the training part gives; one encoding serves all folds."""
    folded = X.with_folds(log, SPEC, 3)
    for f, (train, test, codes) in enumerate(X.fold_data(folded, SPEC, 3)):
        alone, _ = X.training_data(folded.filter(F.col("fold") != f), SPEC)
        assert (train.selection.categories, train.selection.numbers, train.selection.classes) == (
            alone.selection.categories, alone.selection.numbers, alone.selection.classes)
        rows = lambda d, v: sorted((r["case_id"], r["names"], r["numbers"], [tuple(s) for s in r["statics"][v]]) for r in d.rows.collect())
        own = rows(alone, 0)
        assert rows(train, f) == own and train.rows.count() + test.rows.count() == 240


def test_gaps_and_late_static_values(spark):
    rows = [(1, 0, 2, 1, "a", 5.0, None), (1, 0, 2, 3, "b", 7.0, "late"), (2, 1, 1, 1, "a", None, "now")]
    log = spark.createDataFrame(rows, "case_id long, label int, case_length int, event_nr int, act string, v double, kind string")
    spec = LogSpec(static_cols=("kind",), dynamic_cols=("v",), event_col="act", min_share=0.0, keep_short=True)
    vectors = {}
    for k in (1, 3):
        model = OutcomeModel(k, spec, "rf", {"n_estimators": 2, "max_depth": 1}).fit(log)
        names = model.vectorizer.names
        for r in model.vectorizer.transform(log).collect():
            vectors[k, r["case_id"]] = dict(zip(names, r["features"].toArray()))
    assert vectors[1, 1] == {"event1_a": 1.0, "v_event1": 5.0, "kind": 0.0} and vectors[1, 2] == {"event1_a": 1.0, "v_event1": 0.0, "kind": 2.0}
    assert vectors[3, 1] == {"event1_a": 1.0, "event3_b": 1.0, "v_event1": 5.0, "v_event3": 7.0, "kind": 1.0}
    assert vectors[3, 2] == {"event1_a": 1.0, "event3_b": 0.0, "v_event1": 0.0, "v_event3": 0.0, "kind": 2.0}


@pytest.mark.parametrize("method,options,text,text_options", [
    ("rf", {"n_estimators": 5, "max_depth": 3}, "NBLogCountRatioTransformer", {"nr_selected": 4, "pos_label": 1}), ("svm", {"n_components": 16}, None, None),
    ("logit", {}, "LDATransformer", {"num_topics": 2, "passes": 1}), ("logit", {}, "PVTransformer", {"size": 4})])
def test_saved_models_score_as_before(spark, log, tmp_path, method, options, text, text_options):
    model = OutcomeModel(2, SPEC, method, options, text, text_options).fit(log)
    save_model(model, spark, str(tmp_path / "m"))
    again = load_model(spark.newSession(), str(tmp_path / "m"))
    key = lambda m: {r["case_id"]: [round(x, 12) for x in r["p"]] for r in m.predict_proba(log).collect()}
    assert again.spec == SPEC and again.vectorizer.names == model.vectorizer.names and key(again) == key(model)


def test_scaling_keeps_vectors_sparse_and_scores_equal(spark, log):
    from pyspark.ml import classification as C
    from pyspark.ml.functions import vector_to_array

    from caselog.operators import models as M

    data, codes = X.training_data(log, SPEC)
    vectorizer = M.PrefixVectorizer(SPEC, 2).fit_prepared(data, codes)
    train = vectorizer.transform_prepared(data).select("case_id", "features", F.col("label").cast("double").alias("label_index"), F.lit(1.0).alias("weight"))
    size, n = len(vectorizer.names), train.count()
    fitted = M.fit_classifier("logit", train, size, n, {"max_iter": 500, "tol": 1e-12})
    scaled = M.UnitScaler("features", "s", centre=False).fit(train).transform(train)
    first = scaled.select("features", "s").first()
    assert (first["s"].toArray() != 0).sum() <= (first["features"].toArray() != 0).sum()
    centred = M.UnitScaler("features", "_scaled").fit(train).transform(train)
    other = C.LogisticRegression(featuresCol="_scaled", labelCol="label_index", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=500, tol=1e-12).fit(centred)
    key = lambda df, c: {r["case_id"]: r["p"] for r in df.select("case_id", vector_to_array(c)[1].alias("p")).collect()}
    a, b = key(fitted.transform(train), "_probability"), key(other.transform(centred), "probability")
    assert a.keys() == b.keys() and max(abs(a[c] - b[c]) for c in a) < 1e-6


def test_vocabularies_beyond_the_bound_are_refused_before_the_fit(spark):
    docs = spark.createDataFrame([(f"d{i}", f"word{i} word{i} common") for i in range(20)], "doc string, text string")
    with pytest.raises(ValueError, match="21 terms"):
        TopicModel(num_topics=4, model_bytes=21 * 4 * 8 - 1).fit(docs)
    with pytest.raises(ValueError, match="21 terms"):
        WordVectors(size=8, model_bytes=21 * 8 * 8 - 1).fit(docs)
    assert TopicModel(num_topics=4, passes=1, model_bytes=21 * 4 * 8).fit(docs).transform(docs).count() == 20
    assert WordVectors(size=8, min_count=20, model_bytes=64).fit(docs).transform(docs).count() == 20  # one word is that frequent
