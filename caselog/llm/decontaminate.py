"""Benchmark items that leak into documents, found within an edit budget.

Texts are compared in lower case with every run of white space as one blank. An item of m characters may differ from its
place in a document by k = m // 20 edits. Split into k + 1 pieces, at least one piece is then untouched (pigeonhole), so
exact hits of pieces, found by one automaton over all pieces, lead to every leak. Each hit names the stretch of the
document where the item would lie; Myers' bit-parallel distance decides there.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.llm.arrow import Batches, sliced
from caselog.session import Workspace, durable

CHARS_PER_EDIT = 20
LEAST_CHARS = 20
BLOCK_BYTES = 8_000_000
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("start", "end", "edits")]]))


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    return length // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of near equal length, with their offsets."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' search for one item: smallest edit distance to any stretch of a text."""

    def __init__(self, item: str):
        self.size, self.mask, self.top = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
        self.places: dict[str, int] = {}
        for i, c in enumerate(item):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def best(self, text: str, start: int, stop: int) -> tuple[int, int]:
        """(distance, end) of the best match that ends in text[start:stop]; the first of equals."""
        up, down, score, mask, top, places = self.mask, 0, self.size, self.mask, self.top, self.places
        best, end = score, start
        for i in range(start, stop):
            eq = places.get(text[i], 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | (mask & ~(xh | up)), up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            ph, mh = ph << 1 & mask, mh << 1 & mask
            up, down = mh | (mask & ~(xv | ph)), ph & xv
        return best, end


def _border(text: str, at: int) -> bool:
    """Whether no word runs across this place."""
    return at in (0, len(text)) or not (text[at - 1].isalnum() and text[at].isalnum())


@dataclass
class Index:
    """An automaton over the pieces of a block of items."""

    items: list[tuple[int, str]]

    def __post_init__(self):
        self.short: list[tuple[list[int], str]] = []
        self.long: list[tuple[list[int], str]] = []
        by_text: dict[str, list[int]] = {}
        for item_id, text in self.items:
            by_text.setdefault(plain(text), []).append(item_id)
        at: dict[str, list[tuple[int, int]]] = {}
        for text, ids in sorted(by_text.items()):
            if len(text) < LEAST_CHARS:
                if text:
                    at.setdefault(text, []).append((-1 - len(self.short), 0))  # negative: a short item, whole
                    self.short.append((sorted(ids), text))
                continue
            for offset, piece in pieces(text):
                at.setdefault(piece, []).append((len(self.long), offset))
            self.long.append((sorted(ids), text))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.patterns: dict[int, Pattern] = {}

    def find(self, text: str | None) -> list[dict]:
        """The best match of every item that leaks into a text, by item id; places in the plain text."""
        doc = plain(text)
        found: list[dict] = []
        if not doc or not len(self.automaton):
            return found
        met: set[int] = set()
        stretches: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(doc):
            for number, offset in places:
                if number < 0:
                    a, b = last - size + 1, last + 1
                    if number not in met and _border(doc, a) and _border(doc, b):
                        met.add(number)
                        found += [{"item_id": i, "start": a, "end": b, "edits": 0} for i in self.short[-1 - number][0]]
                    continue
                m = len(self.long[number][1])
                start = last - size + 1 - offset
                k = budget(m)
                stretches.setdefault(number, []).append([max(0, start - k), min(len(doc), start + m + k)])
        for number, spans in stretches.items():
            ids, item = self.long[number]
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            pattern = self.patterns.get(number) or self.patterns.setdefault(number, Pattern(item))
            edits, end = min(pattern.best(doc, a, b) for a, b in merged)
            if edits <= budget(len(item)):
                found += [{"item_id": i, "start": max(0, end - len(item)), "end": end, "edits": edits} for i in ids]
        return sorted(found, key=lambda m: (m["item_id"], m["start"]))


def _matches(items: list[tuple[int, str]], at: int):
    """The rows with what leaks into the text at column ``at``."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Batches) -> Batches:
        index = Index(items)
        for batch in sliced(batches, at):
            found = pa.array([index.find(t) for t in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "leaks"])

    return run


def _key(text: str) -> Column:
    """A text as two 64-bit hashes."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(text, F.lit(1)).alias("y"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items found in each whole text, with place and edits.

    Items shorter than 20 plain characters match exactly, at their first place between word borders; empty and null items
    match nothing; items of equal text are all reported. Null and empty texts have no leaks, repeated rows are answered row by
    row, other columns pass through and ``leaks`` replaces one of that name. Places are in the plain text, end exclusive;
    the start is the end less the item's length.

    A block of items (about ``block_bytes``, by hash of the item) travels to the tasks with the code. A larger benchmark
    takes one pass over the documents for each block, whose hits are written before the next block is collected; driver
    and tasks hold one block at a time.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    given = docs.drop("leaks")

    def matched(rows: DataFrame, block: DataFrame) -> DataFrame:
        held = sorted((r["item"], r["text"]) for r in block.collect())  # one block, bounded by block_bytes
        return rows.mapInArrow(_matches(held, rows.columns.index(text_col)), T.StructType([*rows.schema.fields, T.StructField("leaks", LEAKS)]))

    if blocks == 1:
        return matched(given, items).withColumn("leaks", F.array_sort("leaks"))
    texts = given.select(text_col)
    with Workspace(docs.sparkSession) as space:
        hits = None
        for b in range(blocks):
            block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
            found = space.table(matched(texts, block).filter(F.size("leaks") > 0).select(_key(text_col).alias("k"), F.explode("leaks").alias("m")).distinct(), f"hits{b}")
            hits = found if hits is None else hits.union(found)
        leaking = durable(hits.groupBy("k").agg(F.array_sort(F.collect_list("m")).alias("_leaks")).withColumnRenamed("k", "_leak_key"))
    out = given.withColumn("_text_key", _key(text_col)).join(leaking, F.col("_text_key") == F.col("_leak_key"), "left")
    return out.select(*given.columns, F.coalesce("_leaks", F.array().cast(LEAKS)).alias("leaks"))
