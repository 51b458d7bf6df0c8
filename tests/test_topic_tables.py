"""Topics whose word table is no matrix of the driver."""

from collections import Counter

import numpy as np
import pytest

from caselog.operators import models as M
from caselog.operators import topics


@pytest.fixture(scope="module")
def docs(spark):
    """Three groups of documents with words of their own, and awkward rows: no key, one key twice, no words."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{rng.integers(0, 30)}" for _ in range(40))) for i in range(240)]
    return spark.createDataFrame(rows + [(None, "a1 a2"), (None, "a3"), (5, "C1 c2"), (900, ""), (901, None), (902, "onlyhere")], "doc long, text string").cache()


@pytest.fixture
def no_matrix(monkeypatch):
    from pyspark.ml.clustering import LDA

    monkeypatch.setattr(M, "LOCAL_TOPIC_BYTES", 0, raising=False)
    monkeypatch.setattr(LDA, "fit", lambda *_: pytest.fail("the library keeps topics x words on the driver"))


@pytest.mark.parametrize("tfidf", [False, True])
def test_groups_of_documents_are_told_apart(spark, docs, no_matrix, tfidf):
    model = M.TopicModel(num_topics=3, passes=1, subsampling=0.5, min_freq=1, tfidf=tfidf).fit(docs)
    found = model.transform(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc"]: r["values"] for r in found}
    assert by[None] == by[900] == by[901] == by[902] == [0.0, 0.0, 0.0]  # "onlyhere" comes once
    assert {r["doc"]: round(sum(r["values"]), 6) for r in found if r["doc"] is not None and r["doc"] < 900} == {i: 1.0 for i in range(240)}
    groups = Counter((i % 3, int(np.argmax(by[i]))) for i in range(240))
    assert max(groups.values()) <= 81 and len({g for g, _ in groups}) == 3 and sum(n >= 70 for n in groups.values()) == 3
    other = {r["doc"]: r["values"] for r in model.transform(docs.filter("doc in (7, 8)")).collect()}
    assert np.abs(np.array(other[7]) - by[7]).max() < 1e-6 and np.abs(np.array(other[8]) - by[8]).max() < 1e-6


def test_a_table_model_is_saved(spark, docs, no_matrix, tmp_path):
    from caselog.operators.saved import load_model, save_model

    log = docs.selectExpr("doc as case_id", "1 as event_nr", "1 as case_length", "cast(doc % 2 as int) as label", "text as note").filter("doc < 60 and doc != 5")
    model = M.OutcomeModel(1, M.LogSpec(text_col="note"), "logit", {"max_iter": 5}, "lda", {"num_topics": 2, "passes": 1}).fit(log)
    save_model(model, spark, str(tmp_path / "m"))
    key = lambda m: sorted((r["case_id"], [round(x, 9) for x in r["p"]]) for r in m.predict_proba(log).collect())
    assert key(load_model(spark, str(tmp_path / "m"))) == key(model)


def test_steps_of_a_document_are_the_librarys():
    """Topic weights by the plain loop of the library, document by document."""
    rng = np.random.default_rng(3)
    beta, alpha, starts = rng.random((9, 4)), np.array([0.2, 0.3, 0.1, 0.4]), np.array([0, 4])
    weight, begun = rng.integers(1, 5, 9).astype(float), topics._gammas(np.array([5, -6]), 4)
    got, theta, rest = topics._infer(begun, alpha, beta, weight, starts)
    for d, cells in enumerate((slice(0, 4), slice(4, 9))):
        gamma, change = begun[d], 1.0
        e = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
        phi = beta[cells] @ e + 1e-100
        while change > 1e-3:
            last, gamma = gamma, e * (beta[cells].T @ (weight[cells] / phi)) + alpha
            e = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
            phi, change = beta[cells] @ e + 1e-100, np.abs(gamma - last).sum() / 4
        assert np.allclose(got[d], gamma) and np.allclose(theta[d], e) and np.allclose(rest[cells], weight[cells] / phi)
    assert np.allclose(topics.digamma([0.1, 1.0]), [-10.4237549404, -0.5772156649]) and np.allclose(topics.trigamma([0.1, 1.0]), [101.4332991508, 1.6449340668])
    draws = topics._gammas(np.arange(50_000), 2)
    assert abs(draws.mean() - 1.0) < 1e-3 and abs(draws.std() - 0.1) < 1e-3
