"""Exact copies and embedding whitening against brute-force versions."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselog.llm import exact_dedup, whitening

DOCS = "doc_id long, text string, kept string, word string, _xid long"
LONG = "long text " * 40_000


def dedup(spark, folder, rows, **options):
    spark.createDataFrame([(i, t, "old", "w", 1) for i, t in rows], DOCS).repartition(3).write.parquet(f"{folder}/docs")
    out = exact_dedup.exact_duplicates(spark.read.parquet(f"{folder}/docs"), **options)
    assert out.columns == ["doc_id", "text", "word", "_xid", "keep_id", "group_size", "kept", "text_sha256"]
    return out.collect()


def check(rows, got):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i is not None, i or 0, t or "") for i, t in rows)
    keeps = collections.Counter()
    for r in got:
        text = r["text"] or ""
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == max(ids, default=None)
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        keeps[text] += r["kept"]
    assert set(keeps.values()) <= {1} and len(keeps) == len(groups)


AWKWARD = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "b"), (None, "b"), (5, LONG), (6, LONG), (None, "a"), (7, "A"), (8, "a "), (8, "c")]


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD + [(100 + i, "hot") for i in range(3000)] + [(9000 + i, f"t{i % 700}") for i in range(900)], [], [(1, None)]])
def test_exact_copies(spark, tmp_path, rows):
    check(rows, dedup(spark, tmp_path, rows))


def test_a_full_filter_loses_nothing(spark, tmp_path):
    rows = [(i, f"text {i // 2}") for i in range(6000)] + [(10_000 + i, f"single {i}") for i in range(6000)]
    check(rows, dedup(spark, tmp_path, rows, most_bytes=4096))


def test_no_repeat_passes_the_filters_unseen(spark):
    """Words of repeated hashes are all found, in the first filter and, set bit by set bit, in the second."""
    hashes = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("h"))
    words = exact_dedup.repeated_words(hashes)
    twice = {r["w"] for r in spark.range(1000).select(F.shiftrightunsigned(F.xxhash64("id"), 30).alias("w")).collect()}
    assert twice <= {r["word"] for r in words.collect()}
    bitmaps, blocks = exact_dedup.repeat_filter(words)
    block, bits = exact_dedup._places(F.col("word"), blocks)
    placed = words.select(block.alias("block"), bits.alias("bits")).join(bitmaps, "block")
    assert placed.filter(~F.forall("bits", lambda b: exact_dedup._is_set(F.col("bitmap"), b))).count() == 0 and placed.count() == words.count()


def brute_whitening(vectors, components=4):
    x = {i: np.floor(256 * np.array(v, dtype=float)).astype(np.int64) for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(sums), len(sums)))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, values / np.trace(np.cov(fit.T, bias=True).reshape(len(sums), len(sums))), {i: (int(((n * v - sums) ** 2).sum()), (v - sums / n) @ axes / np.sqrt(values)) for i, v in x.items()}


def whitened(spark, vectors):
    df = spark.createDataFrame([(i, v, "z", 1, 2.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, index int, n double")
    return whitening.whiten(df)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    vectors = [[float(np.float32(c)) for c in rng.normal(size=6) @ mix] for _ in range(2500)]
    vectors += [vectors[0]] * 900 + [None, [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [-0.0] * 6]
    n, shares, want = brute_whitening(vectors)
    got = whitened(spark, vectors).collect()
    assert {r["id"] for r in got} == set(want) and len(got) == len(want)
    signs = np.sign([w * g for w, g in zip(want[0][1], next(r for r in got if r["id"] == 0)["whitened"])])
    for r in got:
        deviation, values = want[r["id"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and np.allclose(r["whitened"], signs * values, atol=1e-9) and np.allclose(r["explained"], shares, rtol=1e-9)
        assert r["identity_error"] < 1e-9
    long = whitening.by_component(whitened(spark, vectors[:50]))
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted({r["component"] for r in long.collect()}) == [1, 2, 3, 4] and long.count() == 200


def test_whitening_of_awkward_tables(spark):
    assert whitened(spark, [None, [None]]).count() == 0
    assert [(r["deviation"], r["whitened"]) for r in whitened(spark, [[], []]).collect()] == [(0, []), (0, [])]
    same = whitened(spark, [[1.0, 2.0]] * 3).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, [None, None], [0.0, 0.0], None)] * 3
    line = whitened(spark, [[0.0, 0.0], [1.0, 1.0], [2.0]]).collect()
    assert all(len(r["whitened"]) == 2 and r["whitened"][0] is not None for r in line) and [r["x"] for r in sorted(line)] == [[0, 0], [256, 256], [512, 0]]
    flat = whitened(spark, [[0.0, 3.0], [1.0, 3.0], [5.0, 3.0]]).collect()
    assert all(r["whitened"][1] is None and abs(r["explained"][0] - 1) < 1e-12 for r in flat)


def test_too_many_dimensions_raise(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 2)
    with pytest.raises(ValueError):
        whitened(spark, [[1.0, 2.0, 3.0]])
