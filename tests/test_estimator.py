"""The estimator with Params: saved, loaded, tuned by Spark's own cross-validator over folds of whole cases."""

import json

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from caselog.operators import experiments as X
from caselog.operators.estimator import OutcomeClassifier, OutcomeClassifierModel, read_spec, spec_text
from caselog.operators.models import LogSpec, OutcomeModel

SPEC = LogSpec(static_cols=("kind",), dynamic_cols=("v",), event_col="act", last_state_cols=("act",))
FOREST = json.dumps({"n_estimators": 5, "max_depth": 3})


@pytest.fixture(scope="module")
def log(spark):
    base = spark.range(90).select(F.col("id").cast("int").alias("case_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit(2).alias("case_length"))
    return base.withColumn("event_nr", F.explode(F.sequence(F.lit(1), "case_length"))).select(
        "*", F.when(F.col("event_nr") == 1, "start").otherwise("step").alias("act"), F.concat(F.lit("k"), (F.col("case_id") % 3).cast("string")).alias("kind"),
        (F.col("label") * 5 + F.pmod(F.hash("case_id", "event_nr"), F.lit(7))).cast("double").alias("v")).cache()


def test_parameters_and_fitted_models_survive_a_folder(spark, log, tmp_path):
    assert read_spec(spec_text(SPEC)) == SPEC
    OutcomeClassifier(spec=spec_text(SPEC), nrEvents=2, clsOptions=FOREST).save(str(tmp_path / "estimator"))
    again = OutcomeClassifier.load(str(tmp_path / "estimator"))
    assert again.getOrDefault("nrEvents") == 2 and read_spec(again.getOrDefault("spec")) == SPEC
    fitted = again.fit(log)
    fitted.write().save(str(tmp_path / "model"))
    rows = lambda m: sorted((r["case_id"], r["label"], tuple(r["p"]), r["label_index"]) for r in m.transform(log).collect())
    assert rows(OutcomeClassifierModel.load(str(tmp_path / "model"))) == rows(fitted)
    plain = OutcomeModel(2, SPEC, "rf", json.loads(FOREST)).fit(log).predict_proba(log)
    assert sorted((r["case_id"], tuple(r["p"])) for r in plain.collect()) == [(c, p) for c, _, p, _ in rows(fitted)]


def test_cross_validator_tunes_the_estimator(log):
    folded = X.with_folds(log, SPEC, 3)
    estimator = OutcomeClassifier(spec=spec_text(SPEC), clsOptions=FOREST)
    grid = ParamGridBuilder().addGrid(estimator.nrEvents, [1, 2]).addGrid(estimator.clsMethod, ["rf"]).build()
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label_index")
    tuned = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=3, foldCol="fold").fit(folded)
    assert len(tuned.avgMetrics) == 2 and min(tuned.avgMetrics) > 0.8
    assert tuned.transform(folded).count() == 90


def test_in_a_pipeline_and_with_unknown_labels(spark, log):
    model = Pipeline(stages=[OutcomeClassifier(spec=spec_text(SPEC), nrEvents=2, clsOptions=FOREST)]).fit(log)
    odd = model.transform(log.withColumn("label", F.lit(7))).select("label_index").distinct().collect()
    assert [r["label_index"] for r in odd] == [None]
    none = OutcomeClassifier(spec=spec_text(SPEC), nrEvents=9, clsOptions=FOREST).fit(log)
    assert none.transform(log).count() == 0
