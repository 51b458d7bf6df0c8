"""Steps of the text models: what they shuffle, how many matrices a round sends, and that the rows stay."""

import pytest
from pyspark.sql import functions as F

from caselog.operators import models as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_send_a_matrix_per_core_not_per_part(spark, monkeypatch, request):
    from pyspark.ml.clustering import LDA

    seen, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        before = spark.conf.get(name, None)
        request.addfinalizer(lambda n=name, b=before: spark.conf.unset(n) if b is None else spark.conf.set(n, b))
        spark.conf.set(name, value)
    docs = spark.range(60).select(F.col("id").alias("doc"), F.concat(F.lit("aa bb w"), F.col("id").cast("string")).alias("text")).repartition(24, "doc")
    assert M.TopicModel(num_topics=2, passes=1).fit(docs).transform(docs).count() == 60
    assert seen == [spark.sparkContext.defaultParallelism]


def test_the_table_of_a_fit_gets_its_vectors_once(spark, monkeypatch):
    made, vectors = [], M.TopicModel._vectors
    monkeypatch.setattr(M.TopicModel, "_vectors", lambda self, docs: (made.append(docs), vectors(self, docs))[1])
    rows = [(c, e, 2, c % 2, t) for c, (a, b) in enumerate([("aa bb", "cc"), ("", "bb bb"), ("dd", "aa cc"), (None, "dd")]) for e, t in ((1, a), (2, b))]
    log = spark.createDataFrame(rows, "case_id int, event_nr int, case_length int, label int, txt string")
    block = M.TextBlock("lda", M.LogSpec(text_col="txt"), 2, {"num_topics": 2, "passes": 1})
    block.fit(log)
    key = lambda df: {(r["case_id"], r["feature"]): round(r["number"], 6) for r in df.collect()}
    first = key(block.cells(log))
    assert len(made) == 1
    assert key(block.cells(log.select("*"))) == first and len(made) == 2  # another table: vectors of its own, the same here


@pytest.mark.parametrize("keep_short,texts", [(False, [(1, "b1"), (4, "b4"), (4, "b4")]), (True, [(1, "b1"), (2, "a2"), (4, "b4"), (4, "b4"), (None, "bn")])])
def test_the_last_texts_of_long_cases_need_no_join(spark, monkeypatch, keep_short, texts):
    rows = [(1, 1, 3, 0, "a1"), (1, 2, 3, 0, "b1"), (1, 3, 3, 0, "c1"), (2, 1, 1, 1, "a2"), (4, 1, 2, 1, "a4"), (4, 2, 2, 1, "b4"), (4, 2, 2, 1, "b4"),
            (None, 1, 2, 0, "an"), (None, 2, 2, 0, "bn")]
    log = spark.createDataFrame(rows, "case_id int, event_nr int, case_length int, label int, txt string")
    block, seen = M.TextBlock("bong", M.LogSpec(text_col="txt", keep_short=keep_short), 2), []
    fit = block.worker.fit
    monkeypatch.setattr(block.worker, "fit", lambda docs: (seen.append(docs), fit(docs))[1])
    assert block.fit(log) == [f"txt={t}" for t in sorted({t for _, t in texts})]
    assert sorted(((r["case_id"], r["text"]) for r in seen[0].collect()), key=lambda r: (r[0] or 9, r[1])) == texts
    assert "Join" not in plan(seen[0])
