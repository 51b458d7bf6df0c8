"""Times the headline queries and prints one JSON line: the median of three runs each, their spread, and the forests' case counts.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
The forest runs use as many cases as the published timings (2805 test
cases, four times as many for training, 500 trees).
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import functions as F

from caselog.operators import experiments as X
from caselog.operators import split
from caselog.operators.models import OutcomeModel
from caselog.plans.logs import order_log
from caselog.plans.model_queries import SPEC
from caselog.plans.registry import load_all
from caselog.session import durable, local_session

HEADLINE = [
    "numbered_events", "first_crossings", "alert_metrics_by_case", "two_sided_alerts", "dynamic_columns", "encoded_cells", "category_vocabulary",
    "feature_shares", "static_block", "last_state_values", "stratified_folds", "case_split", "balanced_classes", "auc_of_scores", "coverage_curve",
    "classification_report", "chi_square_scores", "tfidf_weights", "selected_ngrams", "ratio_weighted_terms", "best_parameters",
]
CASES = 14025  # 2805 test cases and four times as many for training
PREFIXES = (1, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.time()
    fn()
    return round(time.time() - start, 3)


def measured(fn, runs: int = 3) -> tuple[float, float]:
    """Median and spread (largest less smallest) of several runs."""
    seconds = [timed(fn) for _ in range(runs)]
    return round(median(seconds), 3), round(max(seconds) - min(seconds), 3)


def forest_runs(spark, sf_dir) -> tuple[dict[str, float], dict[str, int]]:
    """Preparation, training and scoring of 500-tree forests per prefix, on the published number of cases; and the cases of each prefix."""
    log = order_log(spark, sf_dir)
    log = durable(log.join(split.sample_keys(log, "case_id", CASES), "case_id", "left_semi"))
    firsts = log.filter("event_nr = 1").select("case_id", "label")
    train, test = (durable(d) for d in X.split_by_case(log, split.split_exact(firsts, "case_id", 0.8), "case_id"))
    out, cases = {}, {}
    for k in PREFIXES:
        model = OutcomeModel(k, SPEC, "rf", {"n_estimators": 500, "max_depth": 10, "random_state": 22})
        model.fit(train)
        out[f"forest_k{k}_train_preproc"] = round(model.timings["train_preproc_time"], 3)
        out[f"forest_k{k}_train_cls"] = round(model.timings["train_cls_time"], 3)
        out[f"forest_k{k}_test"] = measured(lambda m=model: run(m.predict_proba(test)))[0]
        for side, log_ in (("train", train), ("test", test)):
            cases[f"k{k}_{side}"] = log_.filter((F.col("event_nr") == 1) & (F.col("case_length") >= k)).count()
    return out, cases


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    entries = load_all()
    run(order_log(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1))))  # warm the session
    found = {name: measured(lambda n=name: run(entries[n].build(spark, sf_dir))) for name in HEADLINE}
    times = {name: seconds for name, (seconds, _) in found.items()}
    forests, cases = forest_runs(spark, sf_dir)
    times.update(forests)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "spread": {name: spread for name, (_, spread) in found.items()},
                      "forest_cases": cases}))


if __name__ == "__main__":
    main()
