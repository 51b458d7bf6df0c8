"""From raw documents to pieces: quality, repeated lines, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.llm import decontaminate, line_dedup, near_dedup, pieces, quality_classifier
from caselog.llm.queries import tokenizer_file
from caselog.session import remove_folder, shared_root


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts carry no evidence and are judged like any other; repeated
    rows are judged alike and all stay or go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit_quality(docs, labels)
    score = quality_classifier.quality_score(model)
    return docs.withColumn("_score", score).filter(F.col("_score") >= quality_classifier.THRESHOLD).drop("_score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; a document of which nothing but blanks is left goes, an empty one stays."""
    found = line_dedup.dedup_lines(docs)
    left = found.filter((F.size("deleted") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    text_changed = F.size("deleted") > 0
    return left.select(*[F.when(text_changed, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
                         for c in docs.columns])


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null ids last. Documents without words are no copies and stay."""
    return near_dedup.keep_one_of_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none and stay, and so do repeated rows without one."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, one row per row, and whether they decode to it. An empty text has no ids, a null one is kept null."""
    vocabulary = pieces.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
    encoded = pieces.decode_pieces(pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    counted = pieces.token_counts(encoded, vocabulary)
    return counted.select("doc_id", "lang", "source", "n_tokens", "n_byte_tokens", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate removal", keep_one_of_copies),
    ("benchmark decontamination", drop_leaks),
    ("piece encoding", encode),
]

#: the classifier and the unigram path are beyond SQL; the tests run a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")  # its successor is written
    return docs
