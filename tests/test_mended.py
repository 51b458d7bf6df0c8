"""Cases that once came out wrong: texts in delimited files, several classes, silent levels, null keys, options."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from caselog.functions import text as T
from caselog.operators import metrics, monitor, split
from caselog.operators.models import fit_classifier
from caselog.session import Workspace, shared_root
from caselog.sources import files


def test_delimited_files_keep_every_text(spark, tmp_path):
    rows = [(1, 'a "quoted" word'), (2, "two\nlines; and, more"), (3, ""), (4, None), (5, "  blanks  "), (6, 'ends with "'), (7, "back\\slash\\")]
    df = spark.createDataFrame(rows, "id long, text string")
    for n, (sep, read) in enumerate(((";", lambda p: files.read_text_log(spark, p, ["id", "text"])),
                                     (",", lambda p: files.read_typed_log(spark, p, "id long, text string", sep=",")))):
        path = str(tmp_path / f"log{n}")
        files.write_log(df, path, sep=sep)
        assert sorted((int(r["id"]), r["text"]) for r in read(path).collect()) == rows


def test_result_folders_are_scanned_by_name(spark, tmp_path):
    long = spark.createDataFrame([(0.5, 1.0, "recall")], files.METRIC_SCHEMA)
    files.write_metrics(long, str(tmp_path / "pv_size10_window9_rf_part4"))
    row = files.scan_results(spark, str(tmp_path / "*")).first()
    assert (row["family"], row["size"], row["part"]) == ("pv", "10", "4")


def test_two_sided_alerts_of_three_classes(spark):
    scores = spark.createDataFrame([(1, 1, "b", 2, 0.1, 0.2, 0.7), (1, 2, "b", 2, 0.1, 0.8, 0.1)], "case_id int, nr int, label string, case_length int, a double, b double, c double")
    fired = monitor.two_sided_alerts(scores, "case_id", "nr", [0.6, 0.75], {"a": "a", "b": "b", "c": "c"})
    assert sorted((r["confidence"], r["prediction"], r["nr_events"]) for r in fired.collect()) == [(0.6, "c", 1), (0.75, "b", 2)]


def test_levels_without_alerts_stay(spark):
    fired = spark.createDataFrame([(1, 1, 2, 0.5, 1, 1)], "case_id int, label int, case_length int, confidence double, prediction int, nr_events int")
    cases = spark.createDataFrame([(1, 1), (2, 0)], "case_id int, label int")
    out = {r["confidence"]: r for r in monitor.evaluate_two_sided(fired, cases, 1, confidences=[0.5, 0.9]).collect()}
    assert out[0.5]["tp"] == 1 and out[0.9]["tp"] == 0 and out[0.9]["recall"] == 0 and out[0.9]["failure_rate"] == 1


def test_rows_with_a_null_key_stay(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    assert split.split_exact(df, "k", 0.5).count() == 4


def test_auc_of_counts_beyond_bigint_products(spark):
    big = spark.range(2).select((F.col("id") * 4_000_000_000).alias("_p"), F.lit(4_000_000_000).alias("_before"))
    assert big.select((F.col("_p").cast("double") * F.col("_before")).alias("x")).agg(F.max("x")).first()[0] == 1.6e19
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.9, 1), (0.3, 0)], "s double, y int")
    assert metrics.roc_auc(rows, "s", F.col("y") == 1).first()["auc"] == 1.0


def test_blanks_of_any_script_part_tokens(spark):
    df = spark.createDataFrame([("a b　c d",)], "t string")
    assert df.select(T.split_tokens("t")).first()[0] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("options", [{"max_depth": 31}, {"min_samples_split": 50}])
def test_options_that_cannot_be_kept_raise(spark, options):
    with pytest.raises(ValueError):
        fit_classifier("rf", spark.range(1), 1, 1, options)


def test_a_cluster_must_name_a_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="x")
    with pytest.raises(ValueError):
        shared_root(SimpleNamespace(sparkContext=context))


def test_a_workspace_leaves_nothing(spark, tmp_path):
    import os

    with Workspace(spark) as space:
        kept, gone = space.table(spark.range(3).toDF("id"), "a"), space.table(spark.range(2).toDF("id"), "b")
        space.drop(gone)
        assert kept.count() == 3
        root = space.root.removeprefix("file:")
        assert len(os.listdir(root)) == 1
    assert not os.path.exists(root)
