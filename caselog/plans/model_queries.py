"""Model queries. Their output depends on the learner, so only shape and bounds are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.operators import experiments as X
from caselog.operators import metrics, monitor, split, tune
from caselog.operators.models import LogSpec, OutcomeModel, TopicModel, WordVectors, p_of
from caselog.plans.logs import all_documents, order_log
from caselog.plans.registry import query
from caselog.session import durable

SPEC = LogSpec(static_cols=("o_totalprice", "pr"), dynamic_cols=("l_quantity", "l_extendedprice"), cat_cols=("cat",), event_col="act")
TEXT_SPEC = LogSpec(dynamic_cols=("l_quantity",), event_col="act", text_col="txt")
FOREST = {"n_estimators": 20, "max_depth": 5, "random_state": 22}


def sides(spark, sf):
    """Training and test events, split by case; the mark is kept with the log, since every later job reads one side."""
    marked = durable(split.split_threshold(order_log(spark, sf), "case_id", 0.8))
    return marked.filter("is_train").drop("is_train"), marked.filter("not is_train").drop("is_train")


def scored(spark, sf, spec, method, options, k=2, text_method=None, text_options=None):
    train, test = sides(spark, sf)
    model = OutcomeModel(k, spec, method, options, text_method, text_options).fit(train)
    return model.predict(test).select("case_id", "label", F.round(p_of(model.classes, 1), 6).alias("score"), "prediction")


@query("forest_probabilities", "MO-7 MO-10 UD-4 EN-12")
def forest_probabilities(spark, sf):
    return scored(spark, sf, SPEC, "rf", FOREST)


@query("logit_probabilities", "MO-8 MO-5 MO-10")
def logit_probabilities(spark, sf):
    return scored(spark, sf, SPEC, "logit", {"max_iter": 30})


@query("kernel_margin_probabilities", "MO-9")
def kernel_margin_probabilities(spark, sf):
    return scored(spark, sf, SPEC, "svm", {"n_components": 64, "max_iter": 15})


@query("ngram_model_probabilities", "TX-10 MO-10")
def ngram_model_probabilities(spark, sf):
    return scored(spark, sf, TEXT_SPEC, "rf", FOREST, text_method="BoNGTransformer", text_options={"tfidf": True, "nr_selected": 20})


@query("ratio_model_probabilities", "TX-12 MO-10")
def ratio_model_probabilities(spark, sf):
    return scored(spark, sf, TEXT_SPEC, "rf", FOREST, text_method="NBLogCountRatioTransformer", text_options={"nr_selected": 20, "pos_label": 1})


@query("topic_model_probabilities", "TX-13 TX-15 MO-10")
def topic_model_probabilities(spark, sf):
    return scored(spark, sf, TEXT_SPEC, "rf", FOREST, text_method="LDATransformer", text_options={"num_topics": 5, "passes": 1})


@query("document_topics", "TX-13")
def document_topics(spark, sf):
    docs = all_documents(spark, sf).select(F.col("doc_id").alias("doc"), "text")
    model = TopicModel(num_topics=10, tfidf=False, passes=1, min_freq=1).fit(docs)
    return model.transform(docs).select("doc", *[F.round(F.col("values")[i], 6).alias(f"topic{i + 1}_event1") for i in range(10)])


@query("document_vectors", "TX-14")
def document_vectors(spark, sf):
    docs = all_documents(spark, sf).select(F.col("doc_id").alias("doc"), "text")
    model = WordVectors(size=8, window=5, min_count=2).fit(docs)
    return model.transform(docs).select("doc", *[F.round(F.col("values")[i], 6).alias(f"pv{i + 1}_event1") for i in range(8)])


@query("prefix_scores", "MN-1 MN-2")
def prefix_scores(spark, sf):
    train, test = sides(spark, sf)
    return X.CaseMonitor(SPEC, cls_options=FOREST).train(train).score(test).withColumn("score", F.round("score", 6)).drop("p_0", "p_1")


@query("monitored_alerts", "MN-3 MN-5 MN-7 UD-5")
def monitored_alerts(spark, sf):
    train, test = sides(spark, sf)
    fired, _ = X.CaseMonitor(SPEC, cls_options=FOREST).train(train).test(test, monitor.CONFIDENCES, evaluate=False)
    return fired


@query("monitored_metrics", "MN-7 ME-12 UD-5")
def monitored_metrics(spark, sf):
    train, test = sides(spark, sf)
    _, m = X.CaseMonitor(SPEC, cls_options=FOREST).train(train).test(test, monitor.CONFIDENCES, two_sided=True)
    return m


@query("out_of_fold_predictions", "MO-11 ME-8")
def out_of_fold_predictions(spark, sf):
    log = durable(order_log(spark, sf))
    return X.out_of_fold(log, SPEC, 1, 3, "rf", FOREST).select("case_id", "label", "prediction", "fold")


def forest_setting(depth):
    return {"cls_method": "rf", "cls_options": {**FOREST, "max_depth": int(depth)}, "params": {"depth": str(depth)}}


def folded_metrics(log):
    """Metrics of every setting and level over five folds of ``log``, at all prefixes."""
    return X.cross_validate(log, SPEC, [forest_setting(d) for d in (3, 5)], monitor.CONFIDENCES, folds=5)


@query("cross_validated_metrics", "TU-2")
def cross_validated_metrics(spark, sf):
    return folded_metrics(durable(order_log(spark, sf)))


@query("final_metrics", "TU-4 JN-6")
def final_metrics(spark, sf):
    train, test = sides(spark, sf)
    best = tune.best_parameters(tune.fold_means(durable(folded_metrics(train))), ["depth"])
    return X.final_run(train, test, SPEC, best, lambda r: {k: v for k, v in forest_setting(r["depth"]).items() if k != "params"})


@query("timed_prefixes", "TU-7 IO-6")
def timed_prefixes(spark, sf):
    train, test = sides(spark, sf)
    return X.timed_runs(train, test, SPEC, iterations=10, cls_options=FOREST)


@query("model_coverage", "ME-11 MO-10")
def model_coverage(spark, sf):
    train, test = sides(spark, sf)
    model = OutcomeModel(2, SPEC, "rf", FOREST).fit(train)
    rows = model.predict_proba(test).select(F.col("label").alias("y"), p_of(model.classes, 1).alias("p"))
    return metrics.coverage_curve(rows, "y", "p", monitor.CONFIDENCES)
