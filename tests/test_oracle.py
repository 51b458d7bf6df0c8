"""Every registered query against DuckDB on the small tables; model queries by row count."""

import pytest
from oracle import compare, duck

from caselog.plans.registry import load_all

ENTRIES = load_all()
CHECKED = [n for n, e in ENTRIES.items() if e.sql]
HEAVY = {"cross_validated_metrics", "out_of_fold_predictions", "final_metrics", "timed_prefixes", "kernel_margin_probabilities"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, con, sf_dir, name):
    # a few answers are empty on the smallest tables; the SQL must then be empty too
    found = [f for f in compare(ENTRIES[name].build(spark, sf_dir), con, ENTRIES[name].sql) if f != "no rows"]
    assert found == []


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql and n not in HEAVY])
def test_model_query_gives_rows(spark, sf_dir, name):
    assert ENTRIES[name].build(spark, sf_dir).count() > 0


def test_every_inventory_group_is_covered():
    ids = {i for e in ENTRIES.values() for i in e.covers}
    wanted = {"IO": 9, "PR": 20, "FI": 7, "JN": 7, "AG": 16, "WI": 4, "SO": 5, "ST": 3, "SP": 10, "EN": 13, "TX": 15, "MO": 11,
              "MN": 7, "ME": 12, "TU": 7, "SM": 3}
    missing = [f"{g}-{i}" for g, n in wanted.items() for i in range(1, n + 1) if f"{g}-{i}" not in ids]
    assert missing == []
