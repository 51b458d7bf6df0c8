"""Rows that share an id, null ids and clashing names: nothing is lost, nothing is damaged."""

import builtins
import collections

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from caselog.llm import near_dedup, pii, sharding, token_output

COPY = "one two three four five six seven eight"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_only_the_copy_of_a_repeated_id_goes(spark):
    rows = [(3, COPY), (7, COPY), (7, "another text altogether, not a copy at all")]
    assert sorted(tuple(r)[:2] for r in near_dedup.keep_one_of_copies(table(spark, rows)).collect()) == [rows[0], rows[2]]


def test_one_row_stays_of_null_ids_and_of_repeated_rows(spark):
    rows = [(None, COPY), (None, COPY), (5, COPY + " nine ten"), (5, COPY + " nine ten"), (None, "quite another text with enough words"), (8, None), (8, None), (9, " ")]
    got = collections.Counter(tuple(r)[:2] for r in near_dedup.keep_one_of_copies(table(spark, rows), percent=50).collect())
    assert got == collections.Counter([rows[2], rows[4], (8, None), (8, None), (9, " ")])


def test_stages_take_awkward_rows(spark, sf_dir):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, None), (1, None), (None, ""), (None, "z" * 4000), (2, long), (2, long), (2, "short"), (3, " \n ")]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    docs = table(spark, rows).withColumn("text_hash", F.lit("mine")).withColumn("spans", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        given, got = (collections.Counter(r["doc_id"] for r in d.collect()) for d in (docs, out))
        assert not got - given
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")), sf_dir)
    assert last.count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_sanitised_rows_keep_their_own_text(spark):
    rows = [(1, "write to jo@mail.example now"), (1, "nothing but words only here"), (1, "nothing but words only here"), (None, "call +49 171 2345678"), (2, None), (3, "")]
    docs = table(spark, rows).withColumn("spans", F.lit("s")).withColumn("_id", F.lit(1)).withColumn("text_hash", F.lit(2))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == collections.Counter([(1, "write to [EMAIL] now"), (1, rows[1][1]), (1, rows[1][1]), (None, "call [PHONE]"), (2, None), (3, "")])


def test_shards_take_columns_of_any_name(spark):
    names = ["at", "dim", "cut", "lo", "hi", "leaf", "node", "row", "bin", "key", "_tie", "w", "shard", "k_size"]
    meta = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 9 + 8).alias("size"),
                                   *[F.lit(n).alias(n) for n in names])
    out = sharding.kd_shards(meta, sharding.document_dims(), F.xxhash64("doc_id"), ["doc_id"], shards=5)
    rows = out.collect()
    assert out.columns == [c for c in meta.columns if c != "shard"] + ["shard", "slot"] and len(rows) == 200
    assert all(r[n] == n for r in rows for n in names if n != "shard") and {r["shard"] for r in rows} == set(range(5))


TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "two <|endoftext|> words <|endoftext|><|endoftext|>", "a  <|endoftext|>\n b", "<|endoftext| >", " x\n <|endoftext|>y z"]


def test_ids_are_those_of_the_untouched_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "same id"), (0, "same id, other text")]
    token_output.write_tokens(table(spark, rows), f"{tmp_path}/t", P.path("byte_bpe_50k.json"))
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in token_output.read_tokens(spark, f"{tmp_path}/t").collect())
    assert got == collections.Counter((i, (*library.encode(t, add_special_tokens=False).ids, 2)) for i, t in rows)
    token_output.write_tokens(table(spark, rows[::-1]).repartition(3), f"{tmp_path}/u", P.path("byte_bpe_50k.json"))
    places = lambda p: sorted((r["start"], r["doc_id"], tuple(r["ids"])) for r in token_output.read_tokens(spark, f"{tmp_path}/{p}").collect())
    assert places("t") == places("u")


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    whole = builtins.__import__

    def without(name, *args, **options):
        if name == "caselog.llm.queries":
            raise ImportError("No module named 'ahocorasick'")
        return whole(name, *args, **options)

    monkeypatch.setattr(builtins, "__import__", without)
    names = __spark_entry__.queries()
    assert len(names) > 140 and not any(n.startswith("op1") for n in names) and "pipeline" not in names
