"""Outcome models for one prefix length: log in, class probabilities out.

``PrefixVectorizer`` is a Spark ML estimator (log -> one sparse vector per
case), so it also works inside an ``ml.Pipeline``. ``OutcomeModel`` adds
class weights, scaling and a classifier.
"""

from __future__ import annotations

import time
import weakref
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as MF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from caselog.functions import text as T
from caselog.functions.scalars import sparse_vector
from caselog.operators import encoders, features, skipgram, text, topics
from caselog.operators.encode import RARE_SHARE
from caselog.operators.events import with_case_value
from caselog.operators.prefixes import PrefixSlicer, Selection, case_rows, select_features
from caselog.operators.ranks import lookup_skewed
from caselog.operators.split import oversample
from caselog.session import Workspace, clean_shuffles, durable, remove_folder


SHALLOW = 10  # levels of a tree that is small enough to go out with every round
MOST_CLASSES = 10_000  # classes a model may have; more raise
LOCAL_TOPIC_BYTES = 16 << 20  # a topic model's matrix that the driver and each task may hold; a larger one is a table


@dataclass(frozen=True)
class LogSpec:
    """Roles of the log's columns and the encoding options.

    ``encoding_method``: "onehot" names each category of each event, "ordinal" gives its code among the training log's values (1 on; 0 for
    absent, null and unseen), "label" encodes no events. ``last_state_cols`` add their value at the last event of the prefix in each
    method (text: a name with "onehot", else a code). Values of ``rare_cols`` in under ``rare_share`` of the training cases are grouped
    by keyword first. ``text_cols`` name several text columns, each with a fitted block of its own; ``text_col`` names one.
    """

    case: str = "case_id"
    nr: str = "event_nr"
    label: str = "label"
    length: str = "case_length"
    static_cols: tuple[str, ...] = ()
    dynamic_cols: tuple[str, ...] = ()
    cat_cols: tuple[str, ...] = ()
    event_col: str | None = None
    text_col: str | None = None
    text_cols: tuple[str, ...] = ()
    encoding_method: str = "onehot"
    last_state_cols: tuple[str, ...] = ()
    rare_cols: tuple[str, ...] = ()
    rare_share: float = RARE_SHARE
    min_share: float = features.MIN_SHARE
    keep_short: bool = False
    whole_case: bool = False
    oversample_fit: bool = False
    minority_label: object = None
    seed: int = 22

    @property
    def texts(self) -> tuple[str, ...]:
        """The text columns: ``text_col`` if given, then ``text_cols``, each once."""
        return tuple(dict.fromkeys([*([self.text_col] if self.text_col else []), *self.text_cols]))


# --- a log as case rows, made once for the largest prefix ------------------------------------------------------------


@dataclass
class PreparedLog:
    """Case rows up to the largest prefix, the log for the texts, and the variant of static codes that holds for them."""

    rows: DataFrame
    log: DataFrame
    k_max: int
    variant: int = 0
    selection: Selection | None = None

    def reached(self, spec: LogSpec, k: int) -> DataFrame:
        return self.rows if spec.keep_short else self.rows.filter(F.col(spec.length) >= k)


def prepare(log: DataFrame, spec: LogSpec, k_max: int, codes: dict[str, DataFrame], keep: bool = True) -> PreparedLog:
    """Encode once at the largest prefix; every smaller prefix is a slice of the case rows."""
    rows = case_rows(encoders.encode_events(log, spec, codes), spec, k_max, [codes])
    if keep:
        rows = durable(rows)
    return PreparedLog(rows, with_length(log, spec), k_max)


def with_length(log: DataFrame, spec: LogSpec) -> DataFrame:
    """The log with its case lengths, where texts need them."""
    if spec.texts and spec.length not in log.columns:
        return with_case_value(log, spec.case, log.groupBy(spec.case).agg(F.max(spec.nr).cast("int").alias(spec.length)))
    return log


# --- text blocks: cells (case, feature, number) ----------------------------------------------------------------------


def last_texts(log: DataFrame, spec: LogSpec, k: int, column: str) -> DataFrame:
    """Text of the last event within prefix k, one row per case."""
    at = F.least(F.lit(k), F.col(spec.length))
    return log.filter(F.col(spec.nr) == at).select(spec.case, spec.label, F.coalesce(F.col(column), F.lit("")).alias("text"))


def event_texts(log: DataFrame, spec: LogSpec, k: int, column: str) -> DataFrame:
    """One document per (case, event up to k)."""
    return log.filter(F.col(spec.nr) <= k).select(
        spec.case, F.col(spec.nr).alias("event"), F.concat_ws("/", F.col(spec.case).cast("string"), F.col(spec.nr).cast("string")).alias("doc"),
        F.coalesce(F.col(column), F.lit("")).alias("text"))


def block_cells(blocks: DataFrame, spec: LogSpec, prefix: str) -> DataFrame:
    """(case, feature, number) from one value array per (case, event)."""
    cells = blocks.select(spec.case, "event", F.posexplode("values").alias("_i", "number"))
    name = F.concat(F.lit(prefix), (F.col("_i") + 1).cast("string"), F.lit("_event"), F.col("event").cast("string"))
    return cells.select(spec.case, name.alias("feature"), "number").filter("number <> 0")


def refuse_wide(terms: int, bytes_a_term: int, most: int, what: str) -> None:
    """Raise before a fit whose model would not fit; the vocabulary is never cut."""
    if terms * bytes_a_term > most:
        raise ValueError(f"{what} of {terms} terms at {bytes_a_term} bytes each is over {most} bytes: ask for a larger min count, fewer dimensions, or more model_bytes")


class TopicModel:
    """LDA topics per document; the vocabulary is a table of the whole corpus.

    The library's LDA keeps a matrix of topics x terms on the driver and in each task. Where that passes LOCAL_TOPIC_BYTES, the matrix is
    a table, too (``topics``, by ``operators.topics``), and the driver holds one number a topic. With ``model_bytes`` a fit whose matrix
    would pass that many bytes is refused.
    """

    def __init__(self, num_topics: int = 20, tfidf: bool = False, passes: int = 3, min_prob: float = 0.0, min_freq: int = 0,
                 dictionary: DataFrame | None = None, random_seed: int = 22, subsampling: float = 0.2, key: str = "doc", model_bytes: int | None = None):
        self.num_topics, self.use_tfidf, self.passes, self.min_prob = num_topics, tfidf, passes, min_prob
        self.min_freq, self.dictionary, self.seed, self.subsampling, self.key = min_freq, dictionary, random_seed, subsampling, key
        self.model_bytes, self.model = model_bytes, None
        self.topics: DataFrame | None = None
        self.alpha: list[float] | None = None
        self._fitted: tuple | None = None  # the table of the fit and its vectors

    def _cells(self, docs: DataFrame) -> DataFrame:
        return text.term_counts(docs, self.key, T.split_tokens("text"))

    def _vectors(self, docs: DataFrame) -> DataFrame:
        found = lookup_skewed(self._cells(docs), self.dictionary.select("term", "df", "idx"), "term", "df", F.col(self.key)).filter("idx is not null")
        if self.use_tfidf:
            found = found.withColumn("weight", F.col("tf") * F.log2(F.lit(float(self.n_docs)) / F.col("df")))
            found = text.l2_normalised(found, self.key)
        else:
            found = found.withColumn("weight", F.col("tf").cast("double"))
        grouped = found.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_c"))  # words of one document
        return grouped.select(self.key, sparse_vector("_c.idx", "_c.weight", self.size).alias("features"))

    def _cut(self, docs: DataFrame, space: Workspace, rounds: int = 0) -> DataFrame:
        clean_shuffles(docs.sparkSession)
        return topics.cut(docs, self.key, T.split_tokens("text"), "text", space, rounds, self.subsampling, self.seed)

    def fit(self, docs: DataFrame) -> "TopicModel":
        from pyspark.ml.clustering import LDA

        if self.dictionary is None:
            self.dictionary = durable(text.sorted_vocabulary(self._cells(docs), self.min_freq))
        self.size = max(int(self.dictionary.count()), 1)
        if self.model_bytes is not None:
            refuse_wide(self.size, 8 * self.num_topics, self.model_bytes, "a topic model")
        self.n_docs = docs.count()
        rounds = max(1, round(self.passes / self.subsampling))
        self.model = self.topics = self.alpha = None
        if self.size * 8 * self.num_topics > LOCAL_TOPIC_BYTES:
            space = Workspace(docs.sparkSession)
            weakref.finalize(self, remove_folder, docs.sparkSession, space.root).atexit = False  # what transform returns is kept by itself
            self._fitted = docs, self._cut(docs, space, rounds)
            self.topics, self.alpha = topics.fit(self._fitted[1], self.dictionary, self.num_topics, rounds, self.subsampling, self.seed, self._idf_docs())
            return self
        # a round's task sends a dense matrix of topics x terms, however few its documents: as many tasks as cores, not as parts of the corpus
        self._fitted = docs, durable(self._vectors(docs))
        vectors = self._fitted[1].coalesce(docs.sparkSession.sparkContext.defaultParallelism)
        self.model = LDA(k=self.num_topics, maxIter=rounds, seed=self.seed, optimizer="online", subsamplingRate=self.subsampling,
                         featuresCol="features", topicDistributionCol="_topics").fit(vectors)
        return self

    def _idf_docs(self) -> int | None:
        return self.n_docs if self.use_tfidf else None

    def transform(self, docs: DataFrame) -> DataFrame:
        """Every document with ``values``: its topic shares, below min_prob as 0, all 0 without a known word. The table of the fit has its vectors already."""
        if self.model is None and self.topics is None:
            raise ValueError("fit before transform")
        mine = self._fitted[1] if self._fitted and docs is self._fitted[0] else None
        if self.topics is not None:
            with Workspace(docs.sparkSession) as space:
                cut = self._cut(docs, space) if mine is None else mine
                found = durable(topics.shares(cut, self.dictionary, self.topics, self.alpha, self.seed, self._idf_docs()))
            found = found.withColumnsRenamed({"key": self.key, "shares": "_p"})
        else:
            found = self.model.transform(self._vectors(docs) if mine is None else mine).select(self.key, vector_to_array("_topics").alias("_p"))
        scored = found.select(self.key, F.transform("_p", lambda p: F.when(p >= self.min_prob, p).otherwise(0.0)).alias("_v"))
        zeros = F.array_repeat(F.lit(0.0), self.num_topics)
        return docs.join(scored, self.key, "left").withColumn("values", F.coalesce("_v", zeros)).drop("_v")


class WordVectors:
    """Mean of word vectors per document (a skip-gram model, not paragraph vectors).

    The vocabulary and its vectors are tables (``vectors``: word, vector); the driver holds none of them. With ``model_bytes``
    a fit whose vectors, two per word, would pass that many bytes is refused.
    """

    def __init__(self, size: int = 16, window: int = 8, min_count: int = 1, alpha: float = 0.025, epochs: int = 1,
                 random_seed: int = 22, partitions: int | None = None, key: str = "doc", model_bytes: int | None = None):
        self.size, self.window, self.min_count, self.alpha, self.epochs = size, window, min_count, alpha, epochs
        self.seed, self.partitions, self.key = random_seed, partitions, key
        self.model_bytes, self.vectors = model_bytes, None
        self._fitted: tuple | None = None  # the table of the fit and its dealt texts

    def _dealt(self, docs: DataFrame) -> DataFrame:
        return skipgram.dealt(docs, "text", T.split_tokens("text", lower=False), self.partitions)

    def fit(self, docs: DataFrame) -> "WordVectors":
        self._fitted = docs, self._dealt(docs)
        with Workspace(docs.sparkSession) as space:
            words = space.table(skipgram.words_of_parts(self._fitted[1]), "words")
            vocabulary = skipgram.frequent_words(words, self.min_count)
            if self.model_bytes is not None:
                refuse_wide(vocabulary.count(), 2 * 4 * self.size, self.model_bytes, "a word model")
            self.vectors = skipgram.train(self._fitted[1], words, vocabulary, self.size, self.window, self.alpha, self.epochs, self.seed)
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        """Every document with ``values``, all 0 without a known word. The table of the fit is dealt already."""
        if self.vectors is None:
            raise ValueError("fit before transform")
        texts = self._fitted[1] if self._fitted and docs is self._fitted[0] else self._dealt(docs)
        schema = StructType([*docs.schema.fields, StructField("values", ArrayType(DoubleType()))])
        return skipgram.mean_vectors(texts, self.vectors, self.size, schema)


# Names the model options accept for each text method.
TEXT_METHODS = {
    "BoNGTransformer": "bong", "bong": "bong", "NBLogCountRatioTransformer": "nb", "nb": "nb",
    "LDATransformer": "lda", "lda": "lda", "PVTransformer": "pv", "pv": "pv", None: None,
}


class TextBlock:
    """Text cells of a prefix by one of the four methods, from one text column with a vocabulary of its own."""

    def __init__(self, method: str | None, spec: LogSpec, k: int, options: dict | None = None, column: str | None = None):
        if method not in TEXT_METHODS:
            raise ValueError(f"unknown text method {method!r}")
        self.method, self.spec, self.k, self.column = TEXT_METHODS[method], spec, k, column if column is not None else spec.texts[0]
        options = dict(options or {})
        if self.method in ("bong", "nb"):
            options.setdefault("nr_selected", 100)
            maker = text.NGramSelector if self.method == "bong" else text.LogRatioSelector
            self.worker = maker(spec.case, "text", spec.label, **options)
        elif self.method == "lda":
            self.worker = TopicModel(**options)
        elif self.method == "pv":
            self.worker = WordVectors(**options)
        self.fitted: tuple | None = None  # the log of the fit and its event texts

    def fit(self, log: DataFrame) -> list[str]:
        """Fit and return the feature names."""
        if self.method in ("bong", "nb"):
            self.worker.fit(last_texts(log if self.spec.keep_short else self._long_enough(log), self.spec, self.k, self.column))
            if self.method == "bong" and self.worker.use_tfidf:
                self.worker.frequencies = durable(self.worker.frequencies)
                self.worker.n_docs = durable(self.worker.n_docs)
            self.worker.selected = durable(self.worker.selected)
            # nr_selected rows; "all" is for vocabularies a model can hold
            return [self._name(r["term"]) for r in self.worker.selected.select("term").orderBy("term").collect()]
        docs = event_texts(log, self.spec, self.k, self.column)
        self.worker.fit(docs)
        self.fitted = log, docs
        n = self.worker.num_topics if self.method == "lda" else self.worker.size
        return [f"{self._stem()}{i + 1}_event{e}" for e in range(1, self.k + 1) for i in range(n)]

    def _long_enough(self, log: DataFrame) -> DataFrame:
        """The k-th events: a case has one where its last event within prefix k is the k-th, so no join has to find it."""
        return log.filter((F.col(self.spec.nr) == self.k) & F.col(self.spec.case).isNotNull())

    def _name(self, term: str) -> str:
        return f"{self.column}={term}"

    def _stem(self) -> str:
        """Of topic and vector features: with the column's name where there are several."""
        stem = "topic" if self.method == "lda" else "pv"
        return stem if len(self.spec.texts) == 1 else f"{self.column}_{stem}"

    def cells(self, log: DataFrame) -> DataFrame:
        """(case, feature, number)"""
        if self.method in ("bong", "nb"):
            weights = self.worker.transform(last_texts(log, self.spec, self.k, self.column))
            return weights.select(self.spec.case, F.concat(F.lit(f"{self.column}="), "term").alias("feature"), F.col("weight").alias("number"))
        docs = self.fitted[1] if self.fitted and log is self.fitted[0] else event_texts(log, self.spec, self.k, self.column)
        return block_cells(self.worker.transform(docs), self.spec, self._stem())


# --- one vector per case ---------------------------------------------------------------------------------------------


class PrefixVectorizer(Estimator):
    """Log -> (case, label, case_length, features) for one prefix length."""

    def __init__(self, spec: LogSpec, k: int, text_method: str | None = None, text_options: dict | None = None):
        super().__init__()
        self.spec, self.k, self.text_method, self.text_options = spec, k, text_method, text_options

    def _fit(self, log: DataFrame) -> "PrefixVectorizerModel":
        codes = encoders.fit_codes(log, self.spec)
        return self.fit_prepared(prepare(log, self.spec, self.k, codes), codes)

    def fit_prepared(self, data: PreparedLog, codes: dict[str, DataFrame]) -> "PrefixVectorizerModel":
        spec, k = self.spec, self.k
        chosen = data.selection or select_features(data.rows, spec, data.k_max)[0]
        blocks, texts = [], []
        if TEXT_METHODS[self.text_method]:
            for column in spec.texts:
                blocks.append(TextBlock(self.text_method, spec, k, self.text_options, column))
                texts += blocks[-1].fit(data.log)
        return PrefixVectorizerModel(spec, k, chosen.categories.get(k, []), chosen.numbers.get(k, []), blocks, texts, codes, chosen.lasts.get(k, []))


class PrefixVectorizerModel(Model):
    def __init__(self, spec: LogSpec, k: int, categories: list[str], numbers: list[int], blocks: list[TextBlock], texts: list[str],
                 codes: dict[str, DataFrame], lasts: list[int] = ()):
        super().__init__()
        self.spec, self.k, self.categories, self.numbers, self.lasts = spec, k, categories, numbers, list(lasts)
        self.blocks, self.texts, self.codes = blocks, texts, codes

    @property
    def names(self) -> list[str]:
        return [*self.slicer(0).feature_names(), *self.texts]

    def slicer(self, variant: int) -> PrefixSlicer:
        return PrefixSlicer(self.spec, self.k, self.categories, self.numbers, variant, extra={"_text": len(self.texts)} if self.blocks else None, lasts=self.lasts)

    def _transform(self, log: DataFrame) -> DataFrame:
        return self.transform_prepared(prepare(log, self.spec, self.k, self.codes, keep=False))

    def transform_prepared(self, data: PreparedLog) -> DataFrame:
        spec = self.spec
        rows = data.reached(spec, self.k)
        if self.blocks:
            cells = reduce(DataFrame.unionByName, [b.cells(data.log) for b in self.blocks])  # side by side: names carry their column
            rows = features.vectors(rows, cells, spec.case, self.texts, out="_text")
        return self.slicer(data.variant).transform(rows).select(spec.case, spec.label, spec.length, "features")

    def cells(self, log: DataFrame) -> DataFrame:
        """(case, feature, number): the non-zero entries of each case's vector under their names."""
        rows = self.transform(log)
        names = rows.sparkSession.createDataFrame(list(enumerate(self.names)), "_i int, feature string")  # the fitted list
        entries = rows.select(self.spec.case, F.posexplode(vector_to_array("features")).alias("_i", "number")).filter("number <> 0")
        return entries.join(F.broadcast(names), "_i").select(self.spec.case, "feature", "number")


# --- classifiers -----------------------------------------------------------------------------------------------------


class FourierFeatures(Model):
    """Random Fourier map of the Gaussian kernel (Rahimi & Recht 2007), Arrow batches of numpy work."""

    def __init__(self, inputCol: str, outputCol: str, size: int, n_features: int = 256, gamma: float | None = None, seed: int = 22):
        super().__init__()
        self.inputCol, self.outputCol, self.size = inputCol, outputCol, size
        self.n_features, self.gamma, self.seed = n_features, gamma if gamma is not None else 1.0 / max(size, 1), seed

    def _transform(self, df: DataFrame) -> DataFrame:
        d, m, gamma, seed = self.size, self.n_features, self.gamma, self.seed

        @F.pandas_udf("array<double>")
        def project(batch: pd.Series) -> pd.Series:
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, np.sqrt(2.0 * gamma), (d, m))
            b = rng.uniform(0.0, 2.0 * np.pi, m)
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, d))
            return pd.Series(list(np.sqrt(2.0 / m) * np.cos(x @ w + b)))

        return df.withColumn(self.outputCol, array_to_vector(project(vector_to_array(self.inputCol))))


def fit_classifier(method: str, train: DataFrame, size: int, n: int, options: dict) -> PipelineModel:
    """Fit on columns features, label_index, weight; the result adds ``p``: probabilities per class.

    Forests grow 30 levels at most, which is also what no ``max_depth`` means; a larger depth or an unknown option raises.
    """
    o = dict(options)
    seed = o.pop("random_state", 22)
    if method == "rf":
        depth = o.pop("max_depth", None)
        if depth is not None and depth > 30:
            raise ValueError(f"max_depth is at most 30, not {depth}")
        forest = C.RandomForestClassifier(
            featuresCol="features", labelCol="label_index", weightCol="weight", probabilityCol="_probability", predictionCol="",
            rawPredictionCol="", numTrees=o.pop("n_estimators", 100), maxDepth=30 if depth is None else depth,
            minInstancesPerNode=o.pop("min_samples_leaf", 1), seed=seed,
            # deep trees: keep each row's node between rounds instead of sending all trees out again; shallow ones are walked sooner than kept
            cacheNodeIds=depth is None or depth > SHALLOW, maxMemoryInMB=o.pop("max_memory_mb", 1024))
        stages = [forest]
    elif method in ("logit", "svm"):
        c = float(o.pop("C", 1.0))
        # not centred, so sparse vectors stay sparse: the intercept takes up the means, and the kernel knows differences only
        scaler = UnitScaler("features", "_scaled", centre=False).fit(train)
        if method == "logit":
            model = C.LogisticRegression(
                featuresCol="_scaled", labelCol="label_index", weightCol="weight", probabilityCol="_probability", predictionCol="_prediction",
                rawPredictionCol="_raw", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=o.pop("max_iter", 100), tol=o.pop("tol", 1e-6))
            stages = [scaler, model]
        else:
            mapped = FourierFeatures("_scaled", "_mapped", size, o.pop("n_components", 256), o.pop("gamma", None), seed)
            margin = C.LinearSVC(featuresCol="_mapped", labelCol="label_index", weightCol="weight", rawPredictionCol="_margin",
                                 predictionCol="_side", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=o.pop("max_iter", 50))
            platt = C.LogisticRegression(featuresCol="_margin", labelCol="label_index", weightCol="weight", probabilityCol="_probability",
                                         predictionCol="_prediction", rawPredictionCol="_raw")
            stages = [scaler, mapped, margin, platt]
    else:
        raise ValueError("cls_method is rf, logit or svm")
    if o:
        raise ValueError(f"unknown options for {method}: {sorted(o)}")
    return Pipeline(stages=stages).fit(train)


class UnitScaler(Estimator):
    """Mean 0 (unless ``centre`` is False) and population deviation 1; constant columns become 0."""

    def __init__(self, inputCol: str, outputCol: str, centre: bool = True):
        super().__init__()
        self.inputCol, self.outputCol, self.centre = inputCol, outputCol, centre

    def _fit(self, df: DataFrame) -> PipelineModel:
        n = df.count()
        base = MF.StandardScaler(withMean=self.centre, withStd=True, inputCol=self.inputCol, outputCol="_sample_scaled").fit(df)
        # the library divides by the sample deviation
        factor = (n / (n - 1.0)) ** 0.5 if n > 1 else 1.0
        from pyspark.ml.linalg import Vectors

        stretch = MF.ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(base.mean)), inputCol="_sample_scaled", outputCol=self.outputCol)
        return PipelineModel(stages=[base, stretch])


@dataclass
class OutcomeModel:
    """Class probabilities of cases after their first ``nr_events`` events."""

    nr_events: int
    spec: LogSpec
    cls_method: str = "rf"
    cls_options: dict = field(default_factory=dict)
    text_method: str | None = None
    text_options: dict | None = None

    vectorizer: PrefixVectorizerModel | None = None
    classifier: PipelineModel | None = None
    classes: list = field(default_factory=list)
    timings: dict = field(default_factory=dict)

    def fit(self, log: DataFrame) -> "OutcomeModel":
        codes = encoders.fit_codes(log, self.spec)
        return self.fit_prepared(prepare(log, self.spec, self.nr_events, codes), codes)

    def fit_prepared(self, data: PreparedLog, codes: dict[str, DataFrame]) -> "OutcomeModel":
        fit_together([self], data, codes)
        return self

    def _vectors(self, data: PreparedLog, codes: dict[str, DataFrame]) -> tuple[DataFrame, int] | None:
        """Fit the vectorizer: training vectors with the columns of ``fit_classifier`` and their number; None without a training case."""
        spec = self.spec
        if data.selection is None:
            data = replace(data, selection=select_features(data.rows, spec, data.k_max)[0])
        if data.selection.cases(self.nr_events) == 0:  # nothing to learn: every later score is an empty table
            self.vectorizer, self.classes = PrefixVectorizerModel(spec, self.nr_events, [], [], [], [], codes), []
            return None
        estimator = PrefixVectorizer(spec, self.nr_events, self.text_method, self.text_options)
        self.vectorizer = estimator.fit_prepared(data, codes)
        train = self.vectorizer.transform_prepared(data)
        sizes = data.selection.classes[self.nr_events]
        if spec.oversample_fit and spec.minority_label is not None:
            train = durable(oversample(train, spec.case, spec.label, spec.minority_label, spec.seed))
            sizes = {r[spec.label]: r["n_cases"] for r in features.small_table(features.class_weights(train, spec.label), MOST_CLASSES)}
        sizes = {y: c for y, c in sizes.items() if y is not None}
        self.classes = sorted(sizes)
        n = sum(sizes.values())
        index = F.create_map(*[F.lit(x) for i, y in enumerate(self.classes) for x in (y, float(i))])
        weight = F.create_map(*[F.lit(x) for y in self.classes for x in (y, n / (len(sizes) * sizes[y]))])
        train = train.withColumn("label_index", index[F.col(spec.label)]).withColumn("weight", weight[F.col(spec.label)])
        # said beforehand: a learner would look for the largest label
        return train.select("features", "label_index", "weight").withMetadata("label_index", {"ml_attr": {"type": "nominal", "num_vals": len(self.classes)}}), n

    def score_prepared(self, data: PreparedLog) -> DataFrame:
        """(case, label, case_length, nr_events, p): p holds one probability per entry of ``classes``."""
        if self.vectorizer is None:
            raise ValueError("fit before scoring")
        spec = self.spec
        if not self.classes:
            rows = data.rows.filter(F.lit(False))
            return rows.select(spec.case, spec.label, spec.length, F.lit(self.nr_events).alias("nr_events"), F.array().cast("array<double>").alias("p"))
        return self.score_vectors(self.vectorizer.transform_prepared(data))

    def score_vectors(self, rows: DataFrame) -> DataFrame:
        """``score_prepared`` from the vectors of ``vectorizer.transform_prepared``, for a model with classes."""
        spec = self.spec
        if self.classifier is None:
            scored = rows.withColumn("p", F.array(F.lit(1.0)))
        else:
            scored = self.classifier.transform(rows).withColumn("p", vector_to_array("_probability"))
        return scored.select(spec.case, spec.label, spec.length, F.lit(self.nr_events).alias("nr_events"), "p")

    def predict_proba(self, log: DataFrame) -> DataFrame:
        return self.score_prepared(prepare(log, self.spec, self.nr_events, self.vectorizer.codes, keep=False))

    def predict(self, log: DataFrame) -> DataFrame:
        """predict_proba with ``prediction``: the class of the largest probability."""
        return self.predicted(self.predict_proba(log))

    def predicted(self, scored: DataFrame) -> DataFrame:
        """``prediction`` beside the probabilities ``p``."""
        best = F.array_position("p", F.array_max("p"))
        if not self.classes:
            return scored.withColumn("prediction", F.col(self.spec.label))  # no rows
        names = F.array(*[F.lit(y) for y in self.classes])
        return scored.withColumn("prediction", F.element_at(names, best.cast("int")))


def fit_together(models: list[OutcomeModel], data: PreparedLog, codes: dict[str, DataFrame]) -> None:
    """Fit models that differ in their classifier alone: the vectors are made once for all, and each classifier reads them."""
    first, start = models[0], time.time()
    made = first._vectors(data, codes)
    for m in models:
        m.vectorizer, m.classes, m.classifier = first.vectorizer, first.classes, None
        m.timings.update(train_preproc_time=time.time() - start, train_cls_time=0.0)
    if made is None or len(first.classes) < 2:  # with one class its probability is 1
        return
    train, n = made
    vectors = train.persist(StorageLevel.MEMORY_AND_DISK)  # every learner reads them several times
    try:
        for m in models:
            start = time.time()
            m.classifier = fit_classifier(m.cls_method, vectors, len(m.vectorizer.names), n, m.cls_options)
            m.timings["train_cls_time"] = time.time() - start
    finally:
        vectors.unpersist()


def p_of(classes: list, y):
    """Probability of class y out of ``p``; 0 when the model never saw it."""
    return F.element_at("p", classes.index(y) + 1) if y in classes else F.lit(0.0)
