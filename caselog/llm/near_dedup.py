"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the k smallest of them. Inverted lists
of the retained values give overlaps, the union's sketch estimates the similarity, the full sets decide.

Exact copies become one class first (equal sets, a partial aggregate), so a large group of copies is one entry in the
lists. Two classes at the threshold share at least ``t`` sketch values (for sets within the sketch that is arithmetic,
beyond it a binomial bound missed once in ten million pairs at exactly the threshold), so by the pigeonhole principle a
class needs to be listed only under its ``size - t + 1`` values that come first in one global order. Values of crowded
hash bins come last in that order: text that very many documents share rarely makes lists.

Lists are never expanded into all pairs. First every list compares its members with a pivot of its own, links are
contracted into components, and lists of two members or of one component are done. What is left is compared in blocks
of bounded size on wider signatures, which skip pairs of one component and hand on, of short sets, only as many links
as connect them. No list is capped: every pair of a list that could be linked and isn't yet connected is looked at.
The full sets are made only for documents that pass the sketches.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrow import Batches, Cache, list_array, list_rows, sliced
from caselog.llm.components import components
from caselog.session import Workspace, durable

SKETCH = 64
MISS = 1e-7
BIN_BITS = 16
WIDE = 256
BLOCK = 1024

# odd multipliers, one per place in a shingle, drawn from the hash itself
_PLACE = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in words]


def shingle_set(text: bytes | None, cache: Cache, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles; A-Z lowered, words parted by the six ASCII blanks."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    h = np.array(cache.values(found), dtype=np.uint64)
    if len(h) < words:
        mixed = (h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
    else:
        n = len(h) - words + 1
        mixed = reduce(np.add, (h[i : i + n] * _PLACE[i] for i in range(words)))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(1)).astype(np.int64))


def least_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """The largest t with P(Binomial(k, percent/100) < t) <= miss."""
    p, below, t = percent / 100, 0.0, 0
    while t < k and below + math.comb(k, t) * p**t * (1 - p) ** (k - t) <= miss:
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        t += 1
    return t


def overlap_bound(n: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Sketch values that a set of n shares at least with any set at the threshold."""
    exact = -(-n * percent // 100)
    return np.where(n * 100 <= k * percent, exact, np.minimum(least_overlap(k, percent), exact))


def listed(sketch: np.ndarray, n: int, crowd: np.ndarray, k: int, percent: int) -> np.ndarray:
    """The values a class is listed under, in the global order (crowding of the bin, then value)."""
    first = len(sketch) - int(overlap_bound(np.array([n]), k, percent)[0]) + 1
    return sketch[np.lexsort((sketch, crowd[sketch & (len(crowd) - 1)]))][:first]


def _sketches(k: int, words: int):
    def run(batches: Batches) -> Batches:
        cache = Cache(word_hashes)
        for batch in sliced(batches, 1):
            sets = [shingle_set(t, cache, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), list_array([s[:k] for s in sets], pa.int64())],
                names=["row", "n", "sid", "sketch"])
    return run


def _sets_of(words: int):
    def run(batches: Batches) -> Batches:
        cache = Cache(word_hashes)
        for batch in sliced(batches, 1):
            sets = [shingle_set(t, cache, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(sets, pa.int64())], names=["sid", "set"])
    return run


def _signatures(wide: int, words: int):
    """The low 32 bits of the smallest values: more of a set than the sketch, at half the width."""
    def run(batches: Batches) -> Batches:
        cache = Cache(word_hashes)
        for batch in sliced(batches, 1):
            sets = [shingle_set(t, cache, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            low = [(s[:wide] & 0xFFFFFFFF).astype(np.uint32).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), list_array(low, pa.int32())], names=["sid", "n", "low"])
    return run


def _postings(crowd: np.ndarray, k: int, percent: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            values = [listed(s, size, crowd, k, percent) for s, size in zip(list_rows(batch.column(2)), n)]
            at = np.repeat(np.arange(len(n)), [len(v) for v in values])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values), pa.int64()), batch.column(0).take(pa.array(at)), pa.array(n[at], pa.int64())],
                names=["value", "sid", "n"])
    return run


def _incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    grid = np.zeros((len(sets), len(values)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(values, s)
        at = at[at < len(values)]
        grid[i, at[values[at] == s[: len(at)]]] = 1
    return grid


def _pairs_of(rows: dict, value: int, same: bool, wide: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs between the halves of one group that may be linked; those of one component are left out."""
    n, label, low, mine = rows["n"], rows["label"], rows["low"], rows["mine"]
    half = rows["block"] == rows["i"]
    left, right = (np.flatnonzero(half), np.flatnonzero(half)) if same else (np.flatnonzero(half), np.flatnonzero(~half))
    n_l, n_r = n[left][:, None], n[right][None, :]
    fits = (100 * np.minimum(n_l, n_r) >= percent * np.maximum(n_l, n_r)) & (label[left][:, None] != label[right][None, :])
    if same:
        fits &= left[:, None] < right[None, :]
    if not fits.any():
        return []
    # a pair is looked at in the first list that both are in
    lists, times = np.unique(np.concatenate(mine), return_counts=True)
    lists = lists[(times > 1) & (lists < value)]
    at_l, at_r = [mine[x] for x in left], [mine[x] for x in right]
    for at in range(0, len(lists), 2048):
        fits &= _incidence(at_l, lists[at : at + 2048]) @ _incidence(at_r, lists[at : at + 2048]).T == 0
    if not fits.any():
        return []
    shared = np.zeros(fits.shape, np.float32)
    if fits.sum() < 64:
        for a, b in zip(*np.nonzero(fits)):
            shared[a, b] = len(np.intersect1d(low[left[a]], low[right[b]], assume_unique=True))
    else:
        values, times = np.unique(np.concatenate(low), return_counts=True)
        pool = values[times > 1]
        for at in range(0, len(pool), 2048):
            part = pool[at : at + 2048]
            shared += _incidence([low[x] for x in left], part) @ _incidence([low[x] for x in right], part).T
    whole = np.maximum(n_l, n_r) <= wide  # both sets are in the signature to the last value
    fits &= np.where(whole, 100 * shared >= percent * (n_l + n_r - shared), shared >= overlap_bound(np.maximum(n_l, n_r), wide, percent))
    # surely linked even if two values met by chance in their 32 bits: one such link connects, others are spared
    sure = whole & (100 * (shared - 2) >= percent * (n_l + n_r - shared + 2))
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in zip(*np.nonzero(fits)):
        x, y = root(label[left[a]]), root(label[right[b]])
        if x != y:
            out.append((rows["sid"][left[a]], rows["sid"][right[b]]))
            if sure[a, b]:
                parent[x] = y
    return out


def _block_pairs(wide: int, percent: int):
    """Rows sorted by group (value, i, j) -> pairs; groups are cut out of the stream, the last one waits for its rest."""

    def run(batches: Batches) -> Batches:
        waiting: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> pa.Table | None:
            key = np.stack([table[c].to_numpy() for c in ("value", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            done = cuts if last else cuts[:-1]
            columns = {c: table[c].combine_chunks() for c in ("low", "mine")}
            rows = {c: list_rows(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for c, x in columns.items()}
            rows["low"] = [np.unique(x) for x in rows["low"]]
            plain = {c: table[c].to_numpy() for c in ("n", "block", "i")} | {c: np.array(table[c].to_pylist(), dtype=object) for c in ("sid", "label")}
            found = []
            for a, b in zip(done, done[1:]):
                part = {c: x[a:b] for c, x in (rows | plain).items()}
                found += _pairs_of(part, int(key[0, a]), key[1, a] == key[2, a], wide, percent)
            if found:
                made.append(pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], names=["a", "b"]))
            return None if last else table.slice(done[-1])

        for batch in batches:
            made: list[pa.RecordBatch] = []
            if batch.num_rows:
                table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
                waiting = groups(table.combine_chunks(), False)
                yield from made
        if waiting is not None and waiting.num_rows:
            made = []
            groups(waiting.combine_chunks(), True)
            yield from made

    return run


def _estimate(k: int):
    """Similarity of two sketches: the share of the union's k smallest values that both hold."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    return F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)) / F.size(union)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sid").alias(side), F.col("set").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


class _Search:
    """The steps of one search over shared tables."""

    def __init__(self, given: DataFrame, space: Workspace, percent: int, words: int, k: int, wide: int, block: int):
        self.given, self.space, self.percent, self.words, self.k, self.wide, self.block = given, space, percent, words, k, wide, block
        self.spent: list[DataFrame] = []  # tables that nothing reads once the present step is written

    def clear(self) -> None:
        while self.spent:
            self.space.drop(self.spent.pop())

    def texts_of(self, sids: DataFrame) -> DataFrame:
        """(sid, text): one document of each class."""
        ids = self.space.table(self.reps.join(sids, "sid", "left_semi").select("sid", "row"), "ids")
        self.spent.append(ids)
        # texts whose hash falls in no wanted bin stay where they are; at most 2^20 bins are broadcast
        bin_ = F.pmod(F.xxhash64("row"), F.lit(1 << 20)).cast("int")
        wanted = ids.select(bin_.alias("bin")).distinct()
        likely = self.given.withColumn("bin", bin_).join(F.broadcast(wanted), "bin", "left_semi").drop("bin")
        return likely.join(ids, "row").select("sid", "text")

    def crowding(self) -> np.ndarray:
        """Values per hash bin, 0 for bins as full as chance makes them."""
        bins = self.reps.select(F.explode("sketch").alias("v")).groupBy(F.col("v").bitwiseAND((1 << BIN_BITS) - 1).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        crowd = np.zeros(1 << BIN_BITS, dtype=np.int64)
        for r in bins.collect():  # at most 65,536 bins at any input size
            crowd[r["bin"]] = r["c"]
        usual = crowd.mean()
        crowd[crowd <= usual + 6 * math.sqrt(usual) + 4] = 0
        return crowd

    def lists(self) -> DataFrame:
        postings = self.reps.select("sid", "n", "sketch").mapInArrow(_postings(self.crowding(), self.k, self.percent), "value long, sid binary, n long")
        sizes = postings.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        return self.space.table(postings.join(sizes, "value"), "lists")

    def links(self, pairs: DataFrame) -> DataFrame:
        written = self.space.table(pairs, "pairs")
        self.clear()
        texts = self.texts_of(written.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        sets = self.space.table(texts.mapInArrow(_sets_of(self.words), "sid binary, set array<long>"), "sets")
        found = self.space.table(_verified(written, sets, self.percent), "links")
        self.spent += [sets, written]
        self.clear()
        return found

    def pivot_pairs(self, shared: DataFrame) -> DataFrame:
        """Each list's members against a pivot drawn for that list, as far as size and sketches allow a link."""
        drawn = F.min(F.struct(F.xxhash64("sid", "value").alias("h"), F.col("sid").alias("pivot"), F.col("n").alias("pivot_n"))).alias("p")
        pivots = shared.groupBy("value").agg(drawn).select("value", "p.pivot", "p.pivot_n")
        pairs = shared.join(pivots, "value").filter("sid <> pivot").filter(100 * F.least("n", "pivot_n") >= self.percent * F.greatest("n", "pivot_n"))
        pairs = pairs.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
        named = self.space.table(self.reps.join(shared.select("sid").distinct(), "sid", "left_semi").select("sid", "sketch"), "sketches")
        self.spent.append(named)
        for side in ("a", "b"):
            pairs = pairs.join(named.select(F.col("sid").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
        return pairs.filter(_estimate(self.k) >= least_overlap(self.k, self.percent) / self.k).select("a", "b")

    def labels(self, links: DataFrame) -> DataFrame:
        """(sid, label) of the classes that are linked; others are their own label."""
        return self.space.table(components(links, self.space).select(F.col("node").alias("sid"), "label"), "labels")

    def rest_pairs(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """What is left in lists of several components: each list is cut into blocks, each pair of blocks is one group."""
        here = shared.filter("members > 2").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        open_ = here.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("value")
        left = self.space.table(here.join(open_, "value"), "left")
        texts = self.texts_of(left.select("sid").distinct())
        signatures = self.space.table(texts.mapInArrow(_signatures(self.wide, self.words), "sid binary, n long, low array<int>"), "signatures")
        self.spent += [left, signatures]
        lists_of = left.groupBy("sid").agg(F.array_sort(F.collect_list("value")).alias("mine"))  # no more than a class is listed under
        cut = left.withColumn("blocks", F.ceil(F.col("members") / self.block).cast("int"))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("value", "sid", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        full = dealt.join(signatures.join(lists_of, "sid"), "sid").select("value", "i", "j", "block", "sid", "label", "n", "low", "mine")
        grouped = full.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "sid")
        return grouped.mapInArrow(_block_pairs(self.wide, self.percent), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = 5,
                    k: int = SKETCH, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Two documents are linked when their shingle sets have a Jaccard similarity of at least percent/100; component_id
    is the smallest id reachable over links, kept marks that id's row. A text with fewer than ``words`` words is one
    shingle. Null, empty and blank texts have no shingles and are linked with nothing: they are their own component.
    Rows that repeat an id are separate rows, each with the component of its own text; a null id has the component's
    smallest id, and is kept only when it stands alone. Other columns are ignored, whatever their names.
    """
    found = in_components(docs, id_col, text_col, percent, words, k, wide, block)
    return found.select(id_col, "n_shingles", "component_id", "kept")


def in_components(docs: DataFrame, id_col: str, text_col: str, percent: int = 75, words: int = 5, k: int = SKETCH, wide: int = WIDE,
                  block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with a hash of the text and ``first``: it marks the rows of one id and text in each component (the smallest id,
    null ids last, then the smallest hash) and every row without words."""
    with Workspace(docs.sparkSession) as space:
        # a row is known by its id and a hash of its text; rows equal in both have one set
        given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.struct(F.col("id").alias("i"), F.xxhash64("text").alias("h")))
        search = _Search(given.select("row", "text"), space, percent, words, k, wide, block)
        made = space.table(given.select("row", "text").mapInArrow(_sketches(k, words), "row struct<i:long,h:long>, n long, sid binary, sketch array<long>"), "made")
        names = space.table(made.select("row", "n", "sid"), "names")
        # a class is the documents of one set; any of its rows stands for it, here the first
        search.reps = space.table(made.filter("n > 0").groupBy("sid").agg(F.min(F.struct("row", "n", "sketch")).alias("m")).select("sid", "m.*"), "reps")
        space.drop(made)
        shared = search.lists()
        links = search.links(search.pivot_pairs(shared))
        links = links.union(search.links(search.rest_pairs(shared, search.labels(links))))
        labels = search.labels(links)

        first = F.min(F.struct(F.col("row.i").isNull().alias("no_id"), F.col("row.i").alias("i"), F.col("row.h").alias("h")))
        classes = names.filter("n > 0").groupBy("sid").agg(first.alias("first")).join(labels, "sid", "left")
        classes = classes.select("sid", "first", F.coalesce("label", "sid").alias("label"))
        lows = classes.groupBy("label").agg(F.min("first").alias("low"))
        low_of = classes.join(lows, "label").select("sid", "low")
        component = F.when(F.col("n") > 0, F.col("low.i")).otherwise(F.col("row.i"))
        own = F.struct(F.col("row.i").isNull().alias("no_id"), F.col("row.i").alias("i"), F.col("row.h").alias("h"))
        found = names.join(low_of, "sid", "left").select(
            F.col("row.i").alias(id_col), F.col("row.h").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.coalesce(own == F.col("low"), F.lit(True)).alias("first"))
        return durable(found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def keep_one_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` with one row of each component left: the smallest id, null ids last, then the smallest hash of the text.

    Rows that repeat an id and a text are copies as well and one of them stays. Rows without words are no copies and all stay.
    """
    found = in_components(docs, id_col, text_col, **options)
    key = [F.col(id_col).cast("long").alias("i"), F.col("text_hash").alias("h")]
    counted = found.filter("n_shingles > 0").groupBy(F.struct(*key).alias("_nd_key")).agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    counted = durable(counted.filter("not first or n > 1"))
    known = docs.withColumn("_nd_own", F.struct(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")))
    own = F.col("_nd_own") == F.col("_nd_key")
    alone = known.join(counted.select("_nd_key"), own, "left_anti")
    repeated = known.join(counted.filter("first").select("_nd_key"), own, "left_semi").dropDuplicates(["_nd_own"])
    return alone.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
