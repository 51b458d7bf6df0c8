"""Delimited files and Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.session import shared_root


# Quotes are doubled inside quoted fields, null has a mark of its own, blanks count, and a field may hold line breaks.
# Such files do not split, so Parquet stays the default for large tables.
CSV_TEXT = {"quote": '"', "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_text_log(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Delimited file with a header, every column as text; no pass over the data to guess types."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(**CSV_TEXT).option("multiLine", True).option("sep", sep).option("header", True).schema(schema).csv(path)


def read_typed_log(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ";") -> DataFrame:
    """Delimited file with given types; without a schema Spark reads the file once more to guess them."""
    reader = spark.read.options(**CSV_TEXT).option("multiLine", True).option("sep", sep).option("header", True).option("encoding", "utf-8")
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def write_log(df: DataFrame, path: str, sep: str = ";", mode: str = "errorifexists") -> None:
    """Delimited files with a header, one per partition."""
    df.write.mode(mode).options(**CSV_TEXT).option("sep", sep).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    """Parquet, the default sink."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_metrics(long: DataFrame, path: str, mode: str = "overwrite", run: str | None = None) -> None:
    """(confidence, value, metric) rows; ``w`` replaces, ``a`` appends. A run name becomes a partition."""
    mode = {"w": "overwrite", "a": "append"}.get(mode, mode)
    if run is None:
        long.select("confidence", "value", "metric").write.mode(mode).option("sep", ";").option("header", True).csv(path)
    else:
        tagged = long.select("confidence", "value", "metric", F.lit(run).alias("run"))
        tagged.write.mode(mode).partitionBy("run").option("sep", ";").option("header", True).csv(path)


METRIC_SCHEMA = "confidence double, value double, metric string"


def read_metrics(spark: SparkSession, path: str, with_run: bool = False) -> DataFrame:
    return read_typed_log(spark, path, METRIC_SCHEMA + ", run string" if with_run else METRIC_SCHEMA)


def scan_results(spark: SparkSession, pattern: str) -> DataFrame:
    """All metric files of a pattern in one read, the parameters taken from their names.

    A result is a file named after its parameters, or the folder of that name that ``write_metrics`` makes.
    """
    from caselog.operators.tune import parse_names

    folder = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2))
    own = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    rows = read_metrics(spark, pattern).withColumn("file", F.when(F.col("_metadata.file_name").startswith("part-"), folder).otherwise(own))
    return parse_names(rows, "file")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name inside the cluster's shared checkpoint folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def save_dictionary(vocabulary: DataFrame, path: str) -> None:
    """Keep a fitted (term, df, idx) dictionary for later runs."""
    vocabulary.select("term", "df", "idx").write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
