"""Corpus operators that once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

from caselog.llm import decontaminate, pii, toxicity


def spans_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["s"].split(",") if r["s"] else [] for r in pii.find_personal_data(df).select("doc_id", pii.listing("spans").alias("s")).collect()}


def marks(text, word):
    out, at = [], text.find(word)
    while at >= 0:
        out.append(f"remove:{at}:{at + len(word)}")
        at = text.find(word, at + 1)
    return out


FAR = "and then the day went by with much to do and little to say about it"
OTHERS = [(100 + i, f"call the office, {FAR}") for i in range(60)]


def test_revealing_words_are_marked_in_the_whole_document(spark):
    rows = [(i, f"Zorblax wrote, {FAR}, from jo@mail.example, {FAR}, and Zorblax left") for i in range(4)] + OTHERS
    got = spans_of(spark, rows)
    assert all(set(marks(rows[i][1], "Zorblax")) <= set(got[i]) and not any(x.startswith(("remove", "general")) for x in got[100 + i]) for i in range(4))
    assert len(marks(rows[0][1], "Zorblax")) == 2


def test_a_value_of_one_document_is_judged_as_its_kind(spark):
    names = ["ann", "bob", "cy", "dee"]
    rows = [(i, f"inbox, {FAR}, {n}@mail{i}.example is mine alone{i}") for i, n in enumerate(names)] + OTHERS
    rows.append((50, f"inbox here, {FAR}"))  # no entity: nothing to protect
    got = spans_of(spark, rows)
    # "alone0" occurs once, so it is no evidence; "the" is as common elsewhere
    assert all([x for x in got[i] if not x.startswith("email")][:1] == ["general:0:5"] and f"remove:{rows[i][1].index('mine')}:{rows[i][1].index('mine') + 4}" in got[i] for i in range(4))
    assert got[50] == [] and not any(f":{rows[0][1].index('alone0')}:" in x for x in got[0]) and not any(":11:" in x for x in got[0])


def test_free_words_touch_no_span():
    text = "aa bb cc dd ee"
    assert pii.free_words(text, [(1, 0, 4, "x"), (3, 1, 5, "y"), (9, 2, 10, "z")]) == [(6, 8), (12, 14)]


def weighed(**log_odds):
    """A model in which each named word alone gives its sentence about these log-odds; other sentences have about none."""
    weights = np.zeros(toxicity.SPACE, dtype=np.float32)
    for word, z in log_odds.items():
        own = toxicity.word_parts(word)
        weights[own] += (z + 9) / len(own)
    return toxicity.ToxicModel(weights, -9.0)


def test_sentences_that_carry_a_document_together_are_listed(spark):
    low = float(np.log(0.3 / 0.7))
    model = weighed(qqqqqq=low, zzzzzz=3.0)
    rows = [(1, "calm here. qqqqqq. calm there. qqqqqq"), (2, "calm. qqqqqq"), (3, "qqqqqq. zzzzzz. calm"), (4, "")]
    got = {r["id"]: r["j"] for r in spark.createDataFrame(rows, "id int, text string").select("id", toxicity.judged(model).alias("j")).collect()}
    text = dict(rows)
    listed = {i: [text[i][s["start"] : s["end"]].strip(". ") for s in j["sentences"]] for i, j in got.items()}
    assert abs(got[1]["score"] - 0.51) < 0.01 and listed == {1: ["qqqqqq"], 2: [], 3: ["zzzzzz"], 4: []}


def test_every_toxic_document_has_sentences():
    low = float(np.log(0.3 / 0.7))
    assert toxicity.carrying([(low, 0, 1), (-9.0, 1, 2), (low, 2, 3)], 0.5) == [(low, 0, 1)]
    assert toxicity.carrying([(low, 0, 1), (-9.0, 1, 2), (low, 2, 3), (low, 3, 4)], 0.5) == [(low, 0, 1), (low, 2, 3)]
    assert toxicity.carrying([(2.0, 5, 6), (1.0, 0, 1), (-9.0, 1, 2)], 0.5) == [(1.0, 0, 1), (2.0, 5, 6)]


def test_toxicity_learns_from_twelve_thousand_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    known = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert 11_000 < toxicity.training_rows(docs, known, "toxic", "doc_id", "text", toxicity.MOST_ROWS).count() < 12_500


def test_short_items_are_found_between_word_borders():
    index = decontaminate.Index([(1, "Two words"), (2, "two"), (3, "wo"), (4, "?!"), (5, "two words and a good many more of them")])
    got = {t: [(m["item_id"], m["start"], m["end"]) for m in index.find(t)] for t in ("here are  TWO words, two words", "twofold words", "why?!so", "")}
    assert got == {"here are  TWO words, two words": [(1, 9, 18), (2, 9, 12)], "twofold words": [], "why?!so": [(4, 3, 5)], "": []}


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"the question number {i} asks for much more than a few words {i}") for i in range(20)], "item_id long, text string")
    rows = [(i % 30, f"so the question number {i % 30} asks for much more than a few words {i % 30} ok" if i % 3 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted((r["doc_id"], r["text"] or "", r["leaks"]) for r in decontaminate.find_leaks(docs, bench).collect())
    held, written, made, table = [], [], decontaminate._matches, decontaminate.Workspace.table
    monkeypatch.setattr(decontaminate, "_matches", lambda items, *at: (held.append((len(items), len(written))), made(items, *at))[1])
    monkeypatch.setattr(decontaminate.Workspace, "table", lambda space, df, name: (written.append(name), table(space, df, name))[1])
    blocked = sorted((r["doc_id"], r["text"] or "", r["leaks"]) for r in decontaminate.find_leaks(docs, bench, block_bytes=400).collect())
    assert blocked == whole and len(whole) == 60 and any(leaks for *_, leaks in whole)
    # every block's hits are written before the next block is collected
    assert len(held) > 2 and [n for _, n in held] == list(range(len(held))) and sum(n for n, _ in held) == 20
