"""Corpus operators on awkward rows and against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from caselog.llm import decontaminate, line_dedup, near_dedup, pieces, pii, quality_classifier, quality_rules, sharding, token_output, toxicity
from caselog.llm.arrow import Cache
from caselog.llm.components import components
from caselog.llm.queries import ENTRIES
from caselog.session import Workspace, shared_root

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, shard int, ids string, leaks string, deleted string, score string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    clash = ("z", 9, "z", "z", "z", "z")
    rows = [(1, "one two three four five six seven", "en", "a", 7, *clash), (2, None, "en", "a", 0, *clash), (3, "", None, None, None, *clash),
            (4, " \n\t\n", "en", "b", 4, *clash), (5, LONG, "en", "b", len(LONG), *clash), (6, LONG, "en", "b", len(LONG), *clash),
            (7, "one two three four five six seven", "en", "a", 7, *clash), (7, "one two three four five six seven", "en", "a", 7, *clash),
            (None, "x" * 5000, None, "a", 5000, None, None, None, None, None, None), (8, "two words", "de", None, 9, *clash)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module", params=["awkward", "empty"])
def docs(request, spark):
    df = awkward(spark)
    return df if request.param == "awkward" else df.limit(0)


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (5, 0, 1), (6, 1, 0), (8, None, None), (None, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def size(df):
    return df.count()


def test_shards_take_every_row(docs):
    meta = docs.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("size"))
    out = sharding.kd_shards(meta, sharding.document_dims(), F.xxhash64("doc_id", "size"), ["doc_id"], shards=3).toPandas()
    assert len(out) == size(docs)
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_are_even_and_cut_hot_values(spark):
    meta = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("one").alias("source"), (F.col("id") % 97 + 8).alias("size"))
    out = sharding.kd_shards(meta, sharding.document_dims(), F.xxhash64("doc_id"), ["doc_id"], shards=7).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(out) == 7 and out.max() <= 1.01 * out.mean() + 97
    by_bytes = sharding.kd_shards(meta, sharding.document_dims(), F.xxhash64("doc_id"), ["doc_id"], target_bytes=200_000)
    assert by_bytes.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b")).first()[0] <= 200_000 * 1.01 + 97


def test_token_files_hold_the_librarys_ids(docs, spark):
    path = f"{shared_root(spark)}/tokens-{random.random()}"
    token_output.write_tokens(docs, path, P.path("byte_bpe_50k.json"))
    got = collections.Counter(tuple(r) for r in token_output.token_digests(spark, path).select("doc_id", "n_tokens", "ids_crc32").collect())
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert got == want
    places = [tuple(r) for r in token_output.read_places(spark, path).orderBy("start").collect()]
    assert all(a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
    named = [p[0] for p in places if p[0] is not None]
    assert named == sorted(named)


@pytest.mark.parametrize("text", ["a  b", "a   b", " a", "  a ", "a \n b", "a\n b", "don't  's", " ", "a\tb c", " \n", "<|endoftext|> x", "x  <|endoftext|>", "é日本 語    z"])
def test_chunks_share_no_token(text):
    cache = token_output.encoder(P.path("byte_bpe_50k.json"))
    whole = token_output.Encoder(P.path("byte_bpe_50k.json")).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(cache.values(token_output.chunks(text))), dtype="<u4").tolist() == whole


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(texts):
    """Brute force: every pair of documents."""
    sets, low = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_copies(seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = {}
    for base in range(6):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([7, 40, 150, 700]))]
        for _ in range(12):
            own = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 5, 12])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(own) if rnd.random() < 0.9 else "\n".join(own).upper()
    shared = " ".join(vocabulary[:60])  # a passage that many documents hold
    for _ in range(25):
        texts[len(texts)] = shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 90])))
    return texts


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_are_those_of_all_pairs(spark, block):
    texts = near_copies(5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, block=block).collect()}
    assert got == components_of(texts)


def test_near_duplicates_of_awkward_rows(docs):
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(got) == size(docs)
    if got:
        by_id = collections.defaultdict(set)
        for i, n, c, kept in got:
            by_id[i].add((n, c, kept))
        assert by_id[7] == {(3, 1, False)} and by_id[6] == {(len(shingles(LONG)), 5, False)} and by_id[2] == {(0, 2, True)} and by_id[None] == {(1, None, True)}


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    with Workspace(spark) as space:
        rows = components(edges, space).collect()
    assert {r["node"] for r in rows} == set(range(61)) and {r["label"] for r in rows} == {0}


def test_line_dedup_of_awkward_rows(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*[c for c in docs.columns if c != "deleted"], "deleted"]
    got = out.collect()
    assert len(got) == size(docs)
    if got:
        text = {r["doc_id"]: r["text"] for r in got}
        assert text[5] == LONG and text[6] == "" and text[2] is None and text[4] == " \n\t\n" and text[1] == text[7]


def test_runs_go_at_later_places_only(spark):
    line = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    run = [line("p", 20), line("q", 20), "", line("r", 15)]
    rows = [(1, "\n".join(["own one", *run, "end one"])), (2, "\n".join([line("s", 8), *run, line("t", 9)])), (3, "\n".join(run[:2])), (4, line("u", 60)), (5, line("u", 60) + "\nrest")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: line("s", 8) + "\n" + line("t", 9), 3: rows[2][1], 4: rows[3][1], 5: "rest"}


def test_host_rules_on_awkward_rows(docs):
    got = quality_rules.apply_host_rules(docs).collect()
    assert len(got) == size(docs)
    if got:
        rows = {r["doc_id"]: r for r in got}
        assert rows[2]["base_failed"] and not rows[2]["kept"] and rows[5]["n_words"] == 30_000 and rows[5]["kept"]


def test_host_rates_shrink_small_hosts(spark):
    rows = [("big", i % 10 == 0) for i in range(1000)] + [("small", True)] + [("bad", i % 10 != 0) for i in range(1000)]
    rates = {r["host"]: r["rate_f"] for r in quality_rules.host_rates(spark.createDataFrame(rows, "h string, f boolean"), "h", ["f"]).collect()}
    assert abs(rates["big"] - 0.1) < 0.01 and abs(rates["bad"] - 0.9) < 0.01 and rates["small"] < 0.95


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row)


def test_leaks_are_those_within_the_budget():
    rnd = random.Random(3)
    items = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([25, 60, 130])))) for i in range(12)]
    index = decontaminate.Index(items)
    for _ in range(150):
        i, item = rnd.choice(items)
        edited = list(decontaminate.plain(item))
        for _ in range(rnd.choice([0, 1, 2, 4, 7])):
            at = rnd.randrange(len(edited))
            edited[at : at + 1] = rnd.choice([[], ["z"], [edited[at], "y"]])
        text = "".join(rnd.choice("abcdefgh ") for _ in range(40)) + "".join(edited) + "".join(rnd.choice("abcdefgh ") for _ in range(40))
        doc = decontaminate.plain(text)
        want = {j: d for j, t in items if (d := edit_distance_inside(decontaminate.plain(t), doc)) <= decontaminate.budget(len(decontaminate.plain(t)))}
        assert {m["item_id"]: m["edits"] for m in index.find(text)} == want


def test_leaks_on_awkward_rows(docs, spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x"), (3, ""), (4, "two words"), (5, "w1x1 w2x2 w3x3 w4x4 w5x5")], "item_id long, text string")
    for block_bytes in (8_000_000, 30):
        got = collections.defaultdict(set)
        for r in decontaminate.find_leaks(docs, bench, block_bytes=block_bytes).collect():
            got[r["doc_id"]].add(tuple(m["item_id"] for m in r["leaks"]))
        assert not got or (got[1] == {(1,)} and got[8] == {(4,)} and got[5] == {(5,)} and got[2] == {()} and got[None] == {()})
    assert decontaminate.find_leaks(docs, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0


VOCABULARY = pieces.Pieces.load(P.path("piece_bpe_32k.model"))


def test_paths_score_as_well_as_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces as a unigram model
    score = dict(zip(VOCABULARY.ids.tolist(), VOCABULARY.score.tolist()))
    for i, p in enumerate(model.pieces):
        if i in score:
            p.score = score[i]
        elif p.type == 1:
            p.type = 5
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["Hello there, general.", "  two  blanks ", "日本語 テスト 😀", "line\nbreak", "x" * 400, "antidisestablishmentarianism " * 30, "naïve café"]
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    for text, ids in zip(texts, VOCABULARY.encode(texts, Cache(VOCABULARY.paths))):
        want = library.encode(text)
        assert len(ids) == len(want) or abs(total(ids.tolist()) - total(want)) < 1e-3
        assert abs(total(ids.tolist()) - total(want)) < 1e-3


def test_every_text_returns(docs):
    back = pieces.decode_pieces(pieces.encode_pieces(docs, VOCABULARY), VOCABULARY)
    assert back.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    rows = back.collect()
    assert len(rows) == size(docs) and all(r["text"] == r["decoded"] for r in rows)
    odd = ["▁", "a▁b", " ▁ ", "\x00", "🏳️‍🌈", "\r\n", " lead", "trail "]
    assert [VOCABULARY.decode(i.tolist()) for i in VOCABULARY.encode(odd, Cache(VOCABULARY.paths))] == odd


def plain_base_spans(text):
    """The patterns as they stand, with the library's own search."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(9)
    parts = ["a@b.c", "@", "x.y%z@w-1.org.uk", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49 30 1234567", "007.1.1.1.9", " ", "é", "a@b", "1", "-", "+", "@c.d"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        assert [(a, k, b) for a, k, b, _ in pii.base_spans(text)] == plain_base_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@" * 3 + "1" * 200_000) == []


def test_words_that_give_an_entity_away_are_marked(spark):
    rows = [(i, f"call Zorblax at jo@mail.example now number {i}") for i in range(4)] + [(10 + i, f"call the office at number {i} now, other words here") for i in range(60)]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listing("spans").alias("s")).collect()}
    assert "remove:5:12" in out[0]["s"] and "email:16:31" in out[0]["s"] and ":0:4" not in out[0]["s"] and out[12]["s"] == ""
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[0].startswith("call  at [EMAIL]") and text[12] == rows[6][1]


def test_personal_data_on_awkward_rows(docs):
    got = pii.find_personal_data(docs).collect()
    assert len(got) == size(docs) and all(not r["base"] for r in got)


def test_classifiers_on_awkward_rows(docs, spark):
    for known in (labels(spark), labels(spark, empty=True)):
        for made in (quality_classifier.score_quality(docs, known), toxicity.score_toxicity(docs, known)):
            rows = made.collect()
            assert len(rows) == size(docs) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name,label,least", [("op9_noisy_or_toxicity", "toxic", 0.9), ("op10_nb_svm_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    scored = ENTRIES[name][0](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert len(scored) > 50 and sum(r["predicted"] == r[label] for r in scored) >= least * len(scored)


def test_offending_sentences_are_found(spark):
    clean = "the sun is warm. a day goes by. water runs down"
    rows = [(i, clean + (". you utter grobnak. more talk" if i % 2 else ". you utter friend. more talk")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    for r in toxicity.score_toxicity(df, known).collect():
        assert r["predicted"] == r["doc_id"] % 2
        assert ["grobnak" in r["text"][s["start"] : s["end"]] for s in r["sentences"]] == [True] * (r["doc_id"] % 2)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
