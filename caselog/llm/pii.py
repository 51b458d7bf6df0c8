"""Personal data by patterns, and the words beside it that would give it away.

Patterns find emails, addresses of machines, card and phone numbers. These are the protected entities. The corpus then
tells how much a word discloses of an entity: with n(e), n(t) and n(t, e) the documents that hold the entity, the word,
and both, out of N, the entity's information is IC = log2(N / n(e)) and what the word reveals of it
PMI = log2(N n(t, e) / (n(t) n(e))). A word that reveals a share PMI / IC of at least ``generalise`` is generalised at
all its places in the documents that hold the entity, from ``remove`` on it is removed there. A value held by fewer than
``support`` documents cannot be estimated and is judged as its kind: n(e) are then the documents with any entity of that
kind. A pair must recur in ``support`` documents: what happened once is no evidence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrow import Batches, Cache, sliced
from caselog.session import Workspace, durable

# fixed values: the kinds in the order that spans are listed, and the patterns
KINDS = ["email", "ip", "card", "phone", "general", "remove"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # no match starts inside a run of digits that has none
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]{2,}")

SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95
MERGE = 2_000_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; linear in the text also for endless local parts."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last:
            low = max(last, start - 256)
            kept = text[low:start].rstrip(LOCAL)
            start = low + len(kept)
            if kept:
                break
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind; a match that fails its check is dropped, without a second try."""
    found = [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
    for m in PHONE.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 10 <= len(digits) <= 15:
            found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def _unit(kind: int, value: str | None = None) -> int:
    """What is estimated: an entity value, or a kind as a whole."""
    return _hash(KINDS[kind] if value is None else f"{KINDS[kind]} {value}")


def free_words(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Places of the words of ``text`` that touch no span."""
    out, upto, at = [], 0, 0  # ``upto``: the furthest end of the spans that begin before the word's end
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            upto = max(upto, spans[at][2])
            at += 1
        if upto <= m.start():
            out.append(m.span())
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_ENTITY = pa.list_(pa.struct([("e", pa.int64()), ("k", pa.int64())]))
_SPANS_TYPE = "array<struct<start:int,kind:int,end:int>>"


def _found(batches: Batches) -> Batches:
    """Spans of each text; for texts with any also their entities, and hash, start and end of each free word."""
    cache = Cache(lambda words: [_hash(w) for w in words])
    for batch in sliced(batches, 2):
        texts = [t or "" for t in batch.column(2).to_pylist()]
        spans = [base_spans(t) for t in texts]
        places = [free_words(t, s) if s else [] for t, s in zip(texts, spans)]
        words = cache.rows([[t[a:b].lower() for a, b in own] for t, own in zip(texts, places)])
        entities = [sorted({(_unit(k, v), _unit(k)) for _, k, _, v in s}) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array([[{"start": a, "kind": k, "end": b} for a, k, b, _ in s] for s in spans], _SPAN),
             pa.array([[{"e": e, "k": k} for e, k in own] for own in entities], _ENTITY), pa.array(words, pa.list_(pa.int64())),
             pa.array([[a for a, _ in own] for own in places], pa.list_(pa.int32())), pa.array([[b for _, b in own] for own in places], pa.list_(pa.int32()))],
            names=["id", "h", "base", "entities", "words", "starts", "ends"])


def _marked(batches: Batches) -> Batches:
    """(id, h, base, spans): the base spans and every place of the words in ``told``."""
    for batch in batches:
        rows = batch.select(["base", "words", "starts", "ends", "told"]).to_pylist()
        spans = []
        for r in rows:
            told = {x["t"]: x["kind"] for x in r["told"] or []}
            more = [(a, told[t], b) for t, a, b in zip(r["words"], r["starts"], r["ends"]) if t in told] if told else []
            own = sorted([(x["start"], x["kind"], x["end"]) for x in r["base"]] + more)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "base")), pa.array(spans, _SPAN)], names=["id", "h", "base", "spans"])


def _word_counts(batches: Batches) -> Batches:
    """(t, n): documents of the task that hold a word; merged whenever the part so far grows large."""
    cache = Cache(lambda words: [_hash(w) for w in words])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        t, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        return t[first], np.add.reduceat(n, first)

    def out(pair: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(pair[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in pair], names=["t", "n"])

    for batch in sliced(batches, 0):
        each = []
        for text in batch.column(0).to_pylist():
            words = list(set(WORD.findall((text or "").lower())))
            each.append(np.array(cache.values(words), dtype=np.int64))
        t, n = np.unique(np.concatenate(each), return_counts=True)
        if len(t):
            held.append((t, n))
        if sum(len(t) for t, _ in held) > MERGE:
            held = [merged()]
            if len(held[0][0]) > MERGE // 2:
                yield from out(held[0])
                held = []
    if held:
        yield from out(merged())


def held_units(found: DataFrame, support: int) -> DataFrame:
    """(d, copies, terms, values, kinds, asked, n) of the documents with an entity; ``n`` is a short name of ``d``, fixed once written.

    ``values`` are its values of at least ``support`` documents, ``kinds`` the kinds of all its values; ``asked`` are
    those of them whose words are marked: ``values``, and the kinds of its values that are too rare.
    """
    met = found.filter(F.size("entities") > 0).select(F.struct("id", "h").alias("d"), "entities", F.array_distinct("words").alias("terms"))
    held = met.groupBy("d").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    each = held.select("d", "copies", F.inline("entities"))
    known = each.groupBy("e").agg(F.sum("copies").alias("n")).filter(F.col("n") >= support).select("e", F.lit(True).alias("known"))
    units = each.join(known, "e", "left").groupBy("d").agg(
        F.collect_set(F.when(F.col("known"), F.col("e"))).alias("values"), F.collect_set("k").alias("kinds"),
        F.collect_set(F.when(F.col("known"), F.col("e")).otherwise(F.col("k"))).alias("asked"))
    return held.drop("entities").join(units, "d").withColumn("n", F.monotonically_increasing_id())


def disclosures(held: DataFrame, docs: DataFrame, text_col: str, support: int, generalise: float, space: Workspace) -> DataFrame:
    """(u, t, share): words that reveal at least the share ``generalise`` of the information of a value or a kind."""
    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("N")))  # one row
    units = held.select("copies", "terms", F.explode(F.concat("values", "kinds")).alias("u"))
    n_e = space.table(units.groupBy("u").agg(F.sum("copies").alias("n_e")), "units")
    both = units.select("copies", "u", F.explode("terms").alias("t")).groupBy("u", "t").agg(F.sum("copies").alias("n_te")).filter(F.col("n_te") >= support)
    both = space.table(both, "pairs")
    kinds = F.col("u").isin([_unit(k) for k in range(4)])
    # a kind has as many rows as the corpus has words: its count is broadcast, four rows
    n_te = both.filter(~kinds).join(n_e, "u").unionByName(both.filter(kinds).join(F.broadcast(n_e.filter(kinds)), "u"))
    n_t = docs.select(text_col).mapInArrow(_word_counts, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    pairs = n_te.join(n_t, "t").crossJoin(total)
    ic = F.log2(F.col("N") / F.col("n_e"))
    pmi = F.log2(F.col("N").cast("double") * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))  # an entity in every document has nothing to reveal
    revealing = space.table(pairs.select("u", "t", share.alias("share")).filter(F.col("share") >= generalise), "revealing")
    space.drop(both)
    space.drop(n_e)
    return revealing


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
                       generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(id, base, spans) for each row of ``docs``: arrays of (start, kind, end), code points, end exclusive.

    ``kind`` indexes KINDS; ``base`` has the patterns' spans, ``spans`` also the words to generalise or remove; both by
    start, then kind. Null and empty texts have none. Rows of one id and text share the answer; each counts as a document.
    Other columns are ignored. Null ids are allowed.
    """
    return marked_texts(docs, id_col, text_col, support, generalise, remove).select(id_col, "base", "spans")


def marked_texts(docs: DataFrame, id_col: str, text_col: str, support: int = SUPPORT, generalise: float = GENERALISE,
                 remove: float = REMOVE) -> DataFrame:
    """``find_personal_data`` with a hash of each text: rows of one id may differ in it."""
    key = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    schema = f"id long, h long, base {_SPANS_TYPE}, entities array<struct<e:long,k:long>>, words array<long>, starts array<int>, ends array<int>"
    with Workspace(docs.sparkSession) as space:
        found = space.table(key.mapInArrow(_found, schema), "found")
        held = space.table(held_units(found, support), "held")
        revealing = disclosures(held, docs, text_col, support, generalise, space)
        kind = F.when(F.col("share") >= remove, KINDS.index("remove")).otherwise(KINDS.index("general"))
        asked = held.select("n", "terms", F.explode("asked").alias("u")).select("n", "u", F.explode("terms").alias("t"))
        # a word that reveals several entities is removed if one of them asks for it
        words = asked.join(revealing, ["u", "t"]).groupBy("n", "t").agg(F.max(kind).alias("kind"))
        told = words.groupBy("n").agg(F.collect_list(F.struct("t", "kind")).alias("told")).join(held.select("n", "d"), "n").select("d", "told")
        whole = found.join(told, F.struct(found["id"], found["h"]) == told["d"], "left").select("id", "h", "base", "words", "starts", "ends", "told")
        spans = whole.mapInArrow(_marked, f"id long, h long, base {_SPANS_TYPE}, spans {_SPANS_TYPE}")
        return durable(spans.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "base", "spans"))


def listing(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with their text sanitised: entities become [EMAIL], [IP], [CARD], [PHONE], generalised words [WORD],
    removed ones vanish. Where spans overlap the first by start, then kind, wins. Null texts stay null, empty ones empty.

    One row for each row of ``docs``, in its columns: spans belong to an id and a text, so rows that share an id but not the text keep
    their own, and repeated rows stay. Null ids are allowed, names of columns are free.
    """
    found = marked_texts(docs, id_col, text_col, **options).select(
        F.struct(F.col(id_col).alias("i"), F.col("text_hash").alias("h")).alias("_pd_key"), F.col("spans").alias("_pd_spans")).dropDuplicates(["_pd_key"])

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, spans: pa.Array) -> pa.Array:
        marks = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", ""]
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and own:
                done, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        done += [text[at : s["start"]], marks[s["kind"]]]
                        at = s["end"]
                text = "".join(done) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    key = F.struct(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    joined = docs.withColumn("_pd_own", key).join(found, F.col("_pd_own") == F.col("_pd_key"), "left")
    return joined.select(*[rewrite(F.col(f"`{c}`"), F.col("_pd_spans")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
