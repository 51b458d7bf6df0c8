"""The sliced and split forms must give what the plain forms give, with one key holding a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caselog.operators import metrics, ranks, text
from caselog.operators.events import number_events


@pytest.fixture(scope="module")
def skewed(spark):
    hot = spark.range(1500).select(F.lit("hot").alias("case_id"), F.expr("cast(id * 7919 % 1500 as int)").alias("t"), "id")
    cold = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 700).cast("string")).alias("case_id"), F.expr("cast(id * 31 % 900 as int)").alias("t"), "id")
    return hot.unionByName(cold).withColumn("v", (F.col("id") % 13).cast("double")).cache()


def plain(df):
    w = Window.partitionBy("case_id").orderBy("t", "id")
    return df.withColumn("event_nr", F.row_number().over(w)).withColumn("case_length", F.count(F.lit(1)).over(Window.partitionBy("case_id")))


def same(a, b, cols):
    key = [F.col(c) for c in cols]
    left, right = a.select(*key), b.select(*key)
    return left.count() == right.count() and left.exceptAll(right).isEmpty()


def test_numbering_in_slices(skewed):
    order = [F.col("t"), F.col("id")]
    got = number_events(skewed, "case_id", order, F.floor(F.col("t") / 50), hot_rows=100)
    assert same(got.withColumn("case_length", F.col("case_length").cast("bigint")), plain(skewed), ["case_id", "id", "event_nr", "case_length"])


def test_hot_keys_are_found(skewed):
    assert [r["case_id"] for r in ranks.hot_keys(skewed, "case_id", 100).collect()] == ["hot"]
    assert ranks.hot_keys(skewed, "case_id", 5000) is None


def test_running_values_in_slices(skewed):
    log = plain(skewed).withColumn("maybe", F.when(F.col("id") % 5 == 0, F.col("v")))
    values = {"s": ("sum", "v"), "m": ("max", "v"), "f": ("first", "maybe"), "l": ("last", "maybe")}
    a = ranks.running_in_case(log, "case_id", "event_nr", values, slice_rows=100)
    b = ranks.running_in_case(log, "case_id", "event_nr", values, slice_rows=None)
    assert same(a, b, ["case_id", "event_nr", "s", "m", "f", "l"])


def test_ranks_in_slices(skewed):
    got = ranks.row_number_by_slice(skewed, ["v"], [F.col("t"), F.col("id"), F.col("case_id")], F.floor(F.col("t") / 10), "r")
    w = Window.partitionBy("v").orderBy("t", "id", "case_id")
    assert same(got, skewed.withColumn("r", F.row_number().over(w).cast("bigint")), ["case_id", "id", "r"])


@pytest.mark.parametrize("slices", [None, 16])
def test_contiguous_ids_with_a_hot_value(skewed, slices):
    # a third of the rows shares one key value
    rows = skewed.select(F.when(F.col("case_id") == "hot", F.lit(450)).otherwise(F.col("t")).alias("t"),
                         F.when(F.col("case_id") == "hot", F.col("id")).otherwise(F.col("id") + 10_000).alias("u"))
    got = ranks.contiguous_ids(rows, "t", "n", "u", slices=slices)
    want = rows.withColumn("n", F.row_number().over(Window.orderBy("t", "u")).cast("bigint"))
    assert same(got, want, ["t", "u", "n"])


@pytest.mark.parametrize("kind,key", [
    ("one outlier", "if(id = 0, 1e300D, cast(id AS double))"), ("one stem", "concat('the same stem of every word ', lpad(id, 8, '0'))"),
    ("one script", "concat('\u4e2d\u6587\u8a5e', cast(id AS string))"), ("dates", "date_add(DATE'1970-01-01', cast(id % 20000 AS int))"),
    ("nulls and a third of one value", "if(id % 3 = 0, 'x', if(id % 97 = 0, null, cast(id AS string)))")])
def test_ranges_are_even_and_ranks_exact(spark, kind, key):
    rows = spark.range(0, 40_000, 1, 8).selectExpr("id", f"{key} as k")
    order = [F.col("k"), F.col("id")]
    sizes = [r["n"] for r in ranks.in_ranges(rows, order, 16).groupBy(F.shiftright("_at", 33)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 3 * 40_000 / 16
    got = ranks.rank_by_range(rows, order, "r", slices=16)
    assert same(got, rows.withColumn("r", F.row_number().over(Window.orderBy(*order)).cast("bigint")), ["id", "r"])


def test_ranks_by_range_within_groups(skewed):
    rows = skewed.withColumn("g", F.when(F.col("id") % 5 > 0, F.col("id") % 5))  # a null group too
    order = [F.col("t"), F.col("id"), F.col("case_id")]
    got = ranks.rank_by_range(rows, order, "r", by=["g"], slices=7)
    assert same(got, rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint")), ["case_id", "id", "r"])
    assert ranks.rank_by_range(rows.limit(0), order, "r").count() == 0


def test_numbering_with_struct_slices(skewed):
    order = [F.col("t"), F.col("id")]
    got = number_events(skewed, "case_id", order, F.struct("t", F.floor(F.col("id") / 7)), hot_rows=100)
    assert same(got.withColumn("case_length", F.col("case_length").cast("bigint")), plain(skewed), ["case_id", "id", "event_nr", "case_length"])


def test_lookup_splits_frequent_keys(spark, skewed):
    table = skewed.groupBy("case_id").agg(F.count(F.lit(1)).alias("w"), F.max("v").alias("top"))
    some = table.filter("case_id <> 'c1'")
    got = ranks.lookup_skewed(skewed, some, "case_id", "w", F.col("id"), hot_rows=100)
    want = skewed.join(some, "case_id", "left")
    assert same(got, want, ["case_id", "id", "w", "top"])


def test_tfidf_with_frequent_terms_split_off(spark, monkeypatch):
    docs = spark.range(300).select("id", F.expr("concat('the ', 'w', id % 20, ' the')").alias("text"))
    from caselog.functions import text as T

    cells = text.term_counts(docs, "id", T.words("text"))
    want = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(cells, "id", text.document_frequencies(cells), 300).collect()}
    real = ranks.lookup_skewed
    monkeypatch.setattr(text, "lookup_skewed", lambda *a: real(*a, hot_rows=50))
    got = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(cells, "id", text.document_frequencies(cells), 300).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_auc_does_not_depend_on_slices(skewed, slices):
    d = skewed.withColumn("y", (F.col("id") % 3 == 0).cast("int")).withColumn("s", F.col("t") / 7.0)
    pos = [r["s"] for r in d.filter("y = 1").collect()]
    neg = [r["s"] for r in d.filter("y = 0").collect()]
    from bisect import bisect_left, bisect_right

    neg.sort()
    brute = sum(bisect_left(neg, p) + (bisect_right(neg, p) - bisect_left(neg, p)) / 2 for p in pos) / (len(pos) * len(neg))
    assert metrics.roc_auc(d, "s", F.col("y") == 1, slices=slices).first()["auc"] == pytest.approx(brute, abs=1e-12)


def test_same_answer_for_any_partitioning(spark, skewed):
    got = []
    for n in (1, 7, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = number_events(skewed.repartition(n), "case_id", [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), hot_rows=100)
        got.append(sorted((r["case_id"], r["id"], r["event_nr"]) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]
