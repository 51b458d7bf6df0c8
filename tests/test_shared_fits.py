"""Fits that read the same rows share what is made of them, and give what each gives alone."""

from pyspark.sql import functions as F
from test_passes import FOREST, SPEC, counted, small_log

from caselog.operators import encoders
from caselog.operators import experiments as X
from caselog.operators.models import OutcomeModel, PreparedLog


def scores(df):
    return sorted((r["case_id"], r["nr_events"], [round(p, 9) for p in r["p"]]) for r in df.select("case_id", "nr_events", "p").collect())


def test_settings_share_the_vectors_of_a_prefix(spark):
    data, codes = X.training_data(small_log(spark), SPEC)
    seen = spark.sparkContext.accumulator(0)
    watched = PreparedLog(counted(data.rows, "case_length", seen), data.log, data.k_max, selection=data.selection)
    monitors = [X.CaseMonitor(SPEC, cls_options={**FOREST, "max_depth": d}) for d in (1, 3)]
    X.train_all([(m, watched, codes) for m in monitors])
    assert seen.value == 120  # forty cases at each of three prefixes, once for both settings
    alone = [X.CaseMonitor(SPEC, cls_options=m.cls_options).train_prepared(data, codes) for m in monitors]
    for m, a in zip(monitors, alone):
        assert sorted(m.models) == [1, 2, 3] and all(scores(m.models[k].score_prepared(data)) == scores(a.models[k].score_prepared(data)) for k in m.models)
        assert m.models[2].classifier.stages[0].trees[0].depth <= m.cls_options["max_depth"]


def test_folds_read_the_log_once_for_their_codes(spark):
    log = small_log(spark).withColumn("kind", F.when(F.col("case_id") % 7 != 0, F.concat(F.lit("k"), (F.col("case_id") % 5).cast("string"))))
    spec = X.replace(SPEC, static_cols=("amount", "kind"))
    folded, seen = X.with_folds(log, spec, 4), spark.sparkContext.accumulator(0)
    got = X.fold_codes(counted(folded, "kind", seen), spec, 4)
    assert seen.value == 120
    key = lambda tables: {c: sorted(map(tuple, t.select(c, "code").collect())) for c, t in tables.items()}
    assert [key(t) for t in got] == [key(encoders.fit_codes(folded.filter(F.col("fold") != f), spec)) for f in range(4)]


def test_a_prefix_that_is_named_needs_no_search_for_the_longest_case(spark, monkeypatch):
    log = small_log(spark)
    monkeypatch.setattr(X, "longest_case", lambda *_: 1 / 0, raising=False)
    found = X.out_of_fold(log, SPEC, 1, 4, "rf", FOREST).collect()
    assert sorted(r["case_id"] for r in found) == list(range(40)) and {r["fold"] for r in found} == {0, 1, 2, 3}


def test_models_of_one_specification_share_an_encoding(spark, monkeypatch):
    log, made, prepare = small_log(spark), [], X.prepare
    monkeypatch.setattr(X, "prepare", lambda *a, **b: (made.append(a[1]), prepare(*a, **b))[1])
    make = lambda: [OutcomeModel(2, SPEC, "rf", dict(FOREST)), OutcomeModel(2, SPEC, "logit", {"max_iter": 5})]
    models = X.fit_side_by_side(make(), log)
    together = X.predict_side_by_side(models, log)
    assert len(made) == 2  # one encoding to learn from, one to score
    for found, alone in zip(together, make()):
        assert scores(found) == scores(alone.fit(log).predict(log))
