"""Encoder options of a specification: codes, last states, rare groups, several texts, on a log small enough to write down."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from caselog.operators import experiments as X
from caselog.operators.encode import RareCategories
from caselog.operators.models import LogSpec, OutcomeModel, PrefixVectorizer
from caselog.operators.saved import load_model, save_model

SCHEMA = "case_id int, event_nr int, case_length int, label int, act string, kind string, v double, note string, more string"
TRAIN = [(1, 1, 2, 0, "a", "x", 1.0, "red sky", "one"), (1, 2, 2, 0, "b", None, 2.0, "blue sky", "two"), (2, 1, 3, 1, "a", "y", 0.0, "red sea", "one"),
         (2, 2, 3, 1, None, "x", 5.0, "green sea", "two"), (2, 3, 3, 1, "c", "z", 7.0, "late", "late"), (3, 1, 1, 1, "c", "z", 4.0, "short", "short")]
TEST = [(8, 1, 2, 0, "new", "x", 3.0, "red", "two"), (8, 2, 2, 0, "b", "new", None, "blue new", "sky"), (9, 1, 1, 1, "c", None, 6.0, None, None)]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame(TEST, SCHEMA)


def cells(logs, spec, k=2, **texts):
    out = {}
    for r in PrefixVectorizer(replace(spec, min_share=0.0), k, **texts).fit(logs[0]).cells(logs[1]).collect():
        assert (r["case_id"], r["feature"]) not in out
        out[r["case_id"], r["feature"]] = r["number"]
    return out


def test_ordinal_codes_start_at_one_and_unseen_is_zero(logs):
    spec = LogSpec(event_col="act", cat_cols=("kind",), dynamic_cols=("v",), encoding_method="ordinal", last_state_cols=("act", "kind", "v"))
    # codes a 1, b 2, c 3 and x 1, y 2, z 3; case 9 is too short
    assert cells(logs, spec) == {(8, "event2"): 2, (8, "act_last"): 2, (8, "kind_event1"): 1, (8, "v_event1"): 3}


def test_short_cases_keep_their_last_state(logs):
    spec = LogSpec(event_col="act", last_state_cols=("act", "v"), keep_short=True)
    got = cells(logs, spec)
    assert got == {(8, "event2_b"): 1, (8, "act_last_b"): 1, (9, "event1_c"): 1, (9, "act_last_c"): 1, (9, "v_last"): 6}


def test_label_method_has_static_values_and_last_states_only(logs):
    spec = LogSpec(static_cols=("kind",), event_col="act", cat_cols=("kind",), dynamic_cols=("v",), encoding_method="label", last_state_cols=("act",))
    assert cells(logs, spec) == {(8, "kind"): 1, (8, "act_last"): 2}


def test_last_state_is_that_of_its_prefix(logs):
    spec = LogSpec(last_state_cols=("act", "v"))
    assert cells((logs[0], logs[0]), spec, 1) == {(1, "act_last_a"): 1, (1, "v_last"): 1, (2, "act_last_a"): 1, (3, "act_last_c"): 1, (3, "v_last"): 4}
    assert cells((logs[0], logs[0]), spec, 2) == {(1, "act_last_b"): 1, (1, "v_last"): 2, (2, "act_last_MISSING"): 1, (2, "v_last"): 5}


def test_rare_values_are_grouped_by_the_training_cases(spark):
    kinds = ["often"] * 8 + ["my Business", "tax thing"]
    train = spark.createDataFrame([(i, 1, 1, i % 2, k) for i, k in enumerate(kinds)], "case_id int, event_nr int, case_length int, label int, kind string")
    test = spark.createDataFrame([(20, 1, 1, 0, "my Business"), (21, 1, 1, 0, "often"), (22, 1, 1, 0, "tax thing"), (23, 1, 1, 1, None)],
                                 "case_id int, event_nr int, case_length int, label int, kind string")
    spec = LogSpec(cat_cols=("kind",), rare_cols=("kind",), rare_share=0.2)
    assert cells((train, test), spec, 1) == {(20, "kind_event1_Business"): 1, (21, "kind_event1_often"): 1, (22, "kind_event1_Tax and Payments"): 1}
    with pytest.raises(ValueError):
        RareCategories("kind", 0.0)


def test_each_text_column_has_its_own_block(logs):
    got = cells(logs, LogSpec(text_cols=("note", "more")), text_method="bong", text_options={"nr_selected": 50})
    # "sky" is a word of the first column only, "two" of the second
    assert got == {(8, "note=blue"): 1}
    topics = PrefixVectorizer(LogSpec(text_cols=("note", "more")), 2, "lda", {"num_topics": 2}).fit(logs[0])
    assert topics.texts == [f"{c}_topic{i}_event{e}" for c in ("note", "more") for e in (1, 2) for i in (1, 2)]


def test_an_unknown_method_raises(logs):
    with pytest.raises(ValueError):
        PrefixVectorizer(LogSpec(event_col="act", encoding_method="hash"), 1).fit(logs[0])


@pytest.mark.parametrize("spec", [LogSpec(event_col="act", cat_cols=("kind",), encoding_method="ordinal", last_state_cols=("v", "kind")),
                                  LogSpec(event_col="act", cat_cols=("kind",), rare_cols=("kind",), rare_share=0.3, last_state_cols=("act",)),
                                  LogSpec(event_col="act", text_cols=("note", "more"))])
def test_options_are_saved_and_fold_tables_are_their_own(spark, tmp_path, spec):
    base = spark.range(60).select(F.col("id").cast("int").alias("case_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit(2).alias("case_length"))
    log = base.withColumn("event_nr", F.explode(F.sequence(F.lit(1), "case_length"))).select(
        "*", F.when(F.col("label") == 1, "up").otherwise("down").alias("act"), F.concat(F.lit("k"), (F.col("case_id") % 5).cast("string")).alias("kind"),
        F.col("case_id").cast("double").alias("v"), F.when(F.col("label") == 1, "good news").otherwise("bad news").alias("note"), F.lit("same").alias("more"))
    text = ("bong", {"nr_selected": 3}) if spec.texts else (None, None)
    model = OutcomeModel(2, spec, "rf", {"n_estimators": 3, "max_depth": 3}, *text).fit(log)
    save_model(model, spark, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.spec == spec and again.vectorizer.names == model.vectorizer.names
    assert sorted(model.predict(log).collect()) == sorted(again.predict(log).collect())
    scored = X.out_of_fold(log, spec, 2, 3, "rf", {"n_estimators": 3, "max_depth": 3}) if not spec.texts else None
    assert scored is None or (scored.count() == 60 and scored.filter("prediction = label").count() > 50)


def test_a_log_without_a_case_that_reaches_the_prefix_gives_no_rows(logs):
    for spec, text in ((LogSpec(event_col="act", dynamic_cols=("v",), min_share=0.0), {}), (LogSpec(text_cols=("note",)), {"text_method": "bong", "text_options": {"nr_selected": 3}})):
        fitted = PrefixVectorizer(spec, 3, **text).fit(logs[0])
        assert fitted.transform(logs[1]).count() == 0 and fitted.cells(logs[0]).count() > 0
