"""Outcome models on disk: what was fitted, as JSON, Parquet tables and Spark ML stages in one folder."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from caselog.operators.models import FourierFeatures, LogSpec, OutcomeModel, PrefixVectorizerModel, TextBlock

TABLES = ("selected", "frequencies", "n_docs", "dictionary", "vectors", "topics")  # tables a text block may hold
FACTS = ("size", "n_docs", "alpha")


def _write_json(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0])


def save_model(model: OutcomeModel, spark: SparkSession, path: str) -> None:
    """Write a fitted model to a new folder: specification, feature lists, static codes, text block, classifier stages."""
    if model.vectorizer is None:
        raise ValueError("fit before saving")
    v = model.vectorizer
    for column, table in v.codes.items():
        table.write.parquet(f"{path}/codes/{column}")
    blocks = [_save_block(b, f"{path}/text/{i}") for i, b in enumerate(v.blocks)]
    stages = []
    for i, stage in enumerate(model.classifier.stages if model.classifier is not None else []):
        if isinstance(stage, FourierFeatures):
            stages.append({"inputCol": stage.inputCol, "outputCol": stage.outputCol, "size": stage.size, "n_features": stage.n_features, "gamma": stage.gamma,
                           "seed": stage.seed})
        else:
            PipelineModel(stages=[stage]).save(f"{path}/stages/{i}")
            stages.append(None)
    _write_json(spark, f"{path}/about", {
        "nr_events": model.nr_events, "spec": asdict(model.spec), "cls_method": model.cls_method, "cls_options": model.cls_options, "text_method": model.text_method,
        "text_options": model.text_options, "classes": model.classes, "fitted": model.classifier is not None, "categories": v.categories, "numbers": v.numbers,
        "lasts": v.lasts, "texts": v.texts, "codes": list(v.codes), "blocks": blocks, "stages": stages})


def _save_block(block: TextBlock, path: str) -> dict:
    worker, tables, learned = block.worker, [], None
    for name in TABLES:
        value = getattr(worker, name, None)
        if isinstance(value, DataFrame):
            value.write.parquet(f"{path}/{name}")
            tables.append(name)
    if getattr(worker, "model", None) is not None:
        learned = "topics"
        worker.model.save(f"{path}/model")
    facts = {f: getattr(worker, f) for f in FACTS if isinstance(getattr(worker, f, None), int | list)}
    return {"column": block.column, "facts": facts, "tables": tables, "learned": learned}


def _load_block(spark: SparkSession, path: str, held: dict, model: OutcomeModel) -> TextBlock:
    block = TextBlock(model.text_method, model.spec, model.nr_events, model.text_options, held["column"])
    for name in held["tables"]:
        setattr(block.worker, name, spark.read.parquet(f"{path}/{name}"))
    for name, value in held["facts"].items():
        setattr(block.worker, name, value)
    if held["learned"] == "vectors":  # saved when the library's own model held them
        block.worker.vectors = Word2VecModel.load(f"{path}/model").getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))
    elif held["learned"]:
        block.worker.model = LocalLDAModel.load(f"{path}/model")
    return block


def load_model(spark: SparkSession, path: str) -> OutcomeModel:
    """The model that ``save_model`` wrote; it scores as the one saved."""
    about = _read_json(spark, f"{path}/about")
    spec = LogSpec(**{k: tuple(x) if isinstance(x, list) else x for k, x in about["spec"].items()})
    model = OutcomeModel(about["nr_events"], spec, about["cls_method"], about["cls_options"], about["text_method"], about["text_options"])
    blocks = [_load_block(spark, f"{path}/text/{i}", held, model) for i, held in enumerate(about["blocks"])]
    codes = {c: spark.read.parquet(f"{path}/codes/{c}") for c in about["codes"]}
    model.vectorizer = PrefixVectorizerModel(spec, about["nr_events"], about["categories"], about["numbers"], blocks, about["texts"], codes, about["lasts"])
    model.classes = about["classes"]
    if about["fitted"]:
        stages = [FourierFeatures(**s) if s else PipelineModel.load(f"{path}/stages/{i}").stages[0] for i, s in enumerate(about["stages"])]
        model.classifier = PipelineModel(stages=stages)
    return model
