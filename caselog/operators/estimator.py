"""The outcome model as a Spark ML estimator with ``Params``: for pipelines, parameter maps and ``CrossValidator``; fitted ones are saved and loaded.

A fold must hold whole cases, so give ``CrossValidator`` a ``foldCol`` (``experiments.with_folds``); splits by row would tear cases apart.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.operators.models import LogSpec, OutcomeModel
from caselog.operators.saved import load_model, save_model


def spec_text(spec: LogSpec) -> str:
    """A specification as the text that the ``spec`` parameter holds."""
    return json.dumps(asdict(spec))


def read_spec(text: str) -> LogSpec:
    return LogSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


class OutcomeClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Log -> ``OutcomeClassifierModel``. ``spec``, ``clsOptions`` and ``textOptions`` are JSON, so that they are saved as they are."""

    spec = Param(Params._dummy(), "spec", "specification of the log, JSON (spec_text)", TypeConverters.toString)
    nrEvents = Param(Params._dummy(), "nrEvents", "prefix length", TypeConverters.toInt)
    clsMethod = Param(Params._dummy(), "clsMethod", "rf, logit or svm", TypeConverters.toString)
    clsOptions = Param(Params._dummy(), "clsOptions", "options of the classifier, JSON", TypeConverters.toString)
    textMethod = Param(Params._dummy(), "textMethod", "text method, '' for none", TypeConverters.toString)
    textOptions = Param(Params._dummy(), "textOptions", "options of the text method, JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec: str | None = None, nrEvents: int = 1, clsMethod: str = "rf", clsOptions: str = "{}", textMethod: str = "", textOptions: str = "{}"):
        super().__init__()
        self._setDefault(nrEvents=1, clsMethod="rf", clsOptions="{}", textMethod="", textOptions="{}")
        self._set(**self._input_kwargs)

    def _fit(self, log: DataFrame) -> "OutcomeClassifierModel":
        of = self.getOrDefault
        model = OutcomeModel(of(self.nrEvents), read_spec(of(self.spec)), of(self.clsMethod), json.loads(of(self.clsOptions)), of(self.textMethod) or None,
                             json.loads(of(self.textOptions)))
        return OutcomeClassifierModel(model.fit(log))


class OutcomeClassifierModel(Model, MLReadable, MLWritable):
    """Log -> one row per case that reaches the prefix: case, label, case_length, nr_events, p, and for Spark's evaluators ``probability``
    (a vector), ``label_index`` and ``prediction_index`` (places in ``outcome.classes``; null for a label the training never had)."""

    def __init__(self, outcome: OutcomeModel):
        super().__init__()
        self.outcome = outcome

    def _transform(self, log: DataFrame) -> DataFrame:
        classes = self.outcome.classes
        # without classes there are no rows
        place = F.array_position(F.array(*[F.lit(y) for y in classes]), F.col(self.outcome.spec.label)) if classes else F.lit(None).cast("int")
        best = F.array_position("p", F.array_max("p"))
        return self.outcome.predict_proba(log).withColumns({
            "probability": array_to_vector("p"), "label_index": F.when(place > 0, (place - 1).cast("double")), "prediction_index": (best - 1).cast("double")})

    def write(self) -> "_Writer":
        return _Writer(self)

    @classmethod
    def read(cls) -> "_Reader":
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: OutcomeClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        save_model(self.model.outcome, SparkSession.active(), path)


class _Reader(MLReader):
    def load(self, path: str) -> OutcomeClassifierModel:
        return OutcomeClassifierModel(load_model(SparkSession.active(), path))
