"""Corpus queries against their SQL, and the pipeline against a brute-force version of its rows."""

import collections
import re

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from caselog.llm import decontaminate, quality_classifier
from caselog.llm.queries import ENTRIES

NAMES = [n for n, (_, sql) in ENTRIES.items() if sql]


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, sf_dir, name):
    assert compare(ENTRIES[name][0](spark, sf_dir), duck(sf_dir), ENTRIES[name][1]) == []


def without_later_runs(texts, least=50):
    """Texts by ascending id; windows of at least ``least`` words, forward and backward, are kept where they occur first."""
    first, out = {}, {}
    for i, text in texts:
        raw = (text or "").split("\n")
        lines = [(p, x.strip(" \t\x0b\x0c\r")) for p, x in enumerate(raw)]
        lines = [(p, x, len(x.encode().split())) for p, x in lines if x]
        gone = set()
        for step in (1, -1):
            for a in range(len(lines)):
                words, b = 0, a
                while 0 <= b < len(lines):
                    words += lines[b][2]
                    if words >= least:
                        lo, hi = min(a, b), max(a, b)
                        key = (step, tuple(x for _, x, _ in lines[lo : hi + 1]))
                        if first.setdefault(key, (i, lo)) != (i, lo):
                            gone |= set(range(lines[lo][0], lines[hi][0] + 1))
                        break
                    b += step
        out[i] = (text if not gone else "\n".join(x for p, x in enumerate(raw) if p not in gone), bool(gone))
    return out


def test_pipeline_keeps_what_brute_force_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", "text", quality_classifier.quality_score(model).alias("s")).orderBy("doc_id").collect()
    kept = [(r["doc_id"], r["text"]) for r in scored if r["s"] >= quality_classifier.THRESHOLD]
    cleaned = {i: t for i, (t, gone) in without_later_runs(kept).items() if not gone or re.search(r"[^\x20\x09-\x0D]", t)}

    sets = {}
    for i, t in cleaned.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        met = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, both in met.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i for i, t in cleaned.items() if root(i) == i and not any(x in decontaminate.plain(t) for _, x in items)}

    got = corpus_pipeline.run(spark, sf_dir)
    assert got.filter(~F.col("round_trip")).count() == 0
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    # leaks within the edit budget, but not exact, go as well
    assert ids <= want and all(decontaminate.Index(items).find(cleaned[i]) for i in want - ids)


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
