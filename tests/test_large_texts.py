"""Text queries must keep a task's share of the text bounded, and look a word up once per text."""

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__
from caselog.operators import clean
from caselog.plans import logs


@pytest.fixture
def folder(spark, tmp_path):
    words = [" ".join(f"w{(i * j) % 97}s w{j}" for j in range(100)) for i in range(200)]
    rows = [(i, t if i % 40 else None, "en", "s", 0) for i, t in enumerate(words)] + [(None, "lost cats", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_parts_follow_the_bytes_of_text(spark, folder, monkeypatch):
    monkeypatch.setattr(logs, "TEXT_BYTES", 4096, raising=False)
    total = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    for read in (logs.all_documents, logs.labelled_documents):
        docs = read(spark, folder)
        assert docs.rdd.getNumPartitions() >= total // 4096 > 20
        largest = docs.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
        assert largest < total / 8
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    for name in ("ngram_counts", "sorted_vocabulary"):
        assert compare(__spark_entry__.queries()[name](spark, folder), con, __spark_entry__.oracle_sql()[name]) == []


def test_lemmas_of_awkward_rows(spark):
    df = spark.createDataFrame(
        [(1, ["cats", "and", "cats", "dogs"]), (2, []), (3, None), (None, ["cats"]), (4, ["b", "cats"]), (4, ["a", "cats", "dogs"]), (5, ["cats", None, "x"])],
        "id long, tokens array<string>")
    lexicon = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("birds", "bird")], "token string, lemma string")
    got = sorted(((r["id"], r["lemmas"]) for r in clean.lemmatise(df, "id", "tokens", lexicon, "lemmas").collect()), key=repr)
    twice = (4, "a b cat cat dog")
    assert got == sorted([(1, "cat and cat dog"), (2, ""), (3, ""), (None, ""), twice, twice, (5, "cat x")], key=repr)


def test_only_distinct_words_are_shuffled(spark):
    rows = [(i, ["many", "words"] * 500 + [f"own{i}s"]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    lexicon = spark.createDataFrame([("words", "word")], "token string, lemma string")
    plan = clean.lemmatise(df, "id", "tokens", lexicon, "lemmas")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "posexplode" not in plan
