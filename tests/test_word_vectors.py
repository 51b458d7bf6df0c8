"""Word vectors without a vocabulary on the driver."""

import numpy as np
import pyspark.ml.feature
import pytest

from caselog.operators import skipgram
from caselog.operators.models import WordVectors


def groups(spark, rows=400):
    """Texts of one of two word groups that never meet; by row number."""
    rng = np.random.default_rng(1)
    made = [(i, " ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 12, 30))) for i in range(rows)]
    return spark.createDataFrame(made, "doc int, text string")


def test_the_fit_needs_no_vocabulary_on_the_driver(spark, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("the library's fit collects the vocabulary")

    monkeypatch.setattr(pyspark.ml.feature, "Word2Vec", refused)
    docs = groups(spark)
    model = WordVectors(size=6, window=3, epochs=3, alpha=0.1, partitions=3).fit(docs)
    held = {r["word"]: np.array(r["vector"]) for r in model.vectors.collect()}
    assert sorted(held) == sorted(f"{g}{w}" for g in "ab" for w in range(12))
    unit = {w: v / np.linalg.norm(v) for w, v in held.items()}
    near = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] == b[0]])
    far = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] != b[0]])
    assert near > far + 0.5, (near, far)


@pytest.mark.parametrize("own", [True, False])
def test_values_are_means_over_all_words_of_a_row(spark, own):
    rows = [(1, "aa bb aa rare"), (1, "aa bb aa rare"), (None, "bb"), (2, None), (3, ""), (4, "bb aa cc cc")]
    docs = spark.createDataFrame(rows, "doc int, text string")
    model = WordVectors(size=4, window=2, min_count=3, partitions=2).fit(docs)
    held = {r["word"]: np.array(r["vector"]) for r in model.vectors.collect()}
    assert sorted(held) == ["aa", "bb"]
    got = model.transform(docs if own else spark.createDataFrame(rows, "doc int, text string")).collect()
    key = lambda r: (r[0] or 0, r[1] or "")
    assert [(r["doc"], r["text"]) for r in sorted(got, key=key)] == sorted(rows, key=key)
    for r in got:
        words = (r["text"] or "").split()
        expected = sum((held.get(w, np.zeros(4)) for w in words), np.zeros(4)) / max(len(words), 1)
        assert np.allclose(r["values"], expected)


def test_parts_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "PART_BYTES", 2000)
    texts = skipgram.dealt(groups(spark), "text", skipgram.F.split("text", " "))
    assert texts.select(skipgram.PART).distinct().count() > 10


def test_no_texts_give_no_vectors(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc int, text string")
    got = WordVectors(size=3).fit(docs).transform(docs).collect()
    assert sorted((r["doc"], r["values"]) for r in got) == [(1, [0.0] * 3), (2, [0.0] * 3)]
