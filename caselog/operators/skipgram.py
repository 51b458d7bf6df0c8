"""Skip-gram word vectors whose vocabulary is a table: no machine holds more than the words of one part of the texts.

The texts are dealt into parts of bounded size. A part is trained by itself, from the vectors that its words have so far, and a
word's new vector is the mean over the parts that hold it, as in Spark's own Word2Vec, which keeps all words on the driver instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.session import durable

PART_BYTES = 16 << 20  # bytes of text in one part
NEGATIVES = 5  # noise words for each pair
BLOCK = 256  # words that are trained on at once
NOISE = 128  # noise words that a block shares
MOST_STEP = 1.0  # a block moves no vector by more than this many times its mean gradient
ROW, TOKENS, PART = "_row", "_tokens", "_part"


def dealt(docs: DataFrame, text: str, tokens: Column, parts: int | None = None) -> DataFrame:
    """Every row with its tokens, placed by its part. The rows are stored first, since parts are dealt by a row's place; tokens, larger than the text, are not."""
    stored = durable(docs.withColumn(ROW, F.monotonically_increasing_id()))
    if parts is None:
        size = stored.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))  # hashes put several parts into one task
    placed = stored.withColumn(PART, F.pmod(F.xxhash64(ROW), F.lit(parts)).cast("int")).repartition(parts, PART)
    return placed.withColumn(TOKENS, tokens)


def words_of_parts(texts: DataFrame) -> DataFrame:
    """(part, word, n): a row per word of each part."""
    return texts.select(PART, F.explode(TOKENS).alias("word")).groupBy(PART, "word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(words: DataFrame, min_count: int) -> DataFrame:
    """(word, n) of the words that all parts together hold ``min_count`` times."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def train(texts: DataFrame, words: DataFrame, vocabulary: DataFrame, size: int, window: int, alpha: float, epochs: int, seed: int) -> DataFrame:
    """(word, vector) of every word of the vocabulary after ``epochs`` passes over the texts."""
    known = words.select(PART, "word").join(vocabulary, "word")
    rows = texts.select(PART, ROW, TOKENS)
    state = None
    for epoch in range(epochs):
        given = known.withColumn("seed", F.xxhash64("word", F.lit(seed)))
        given = given.withColumn("state", F.lit(None).cast("array<float>")) if state is None else given.join(state, "word")
        learn = _learner(size, window, alpha, epoch, epochs, seed)
        found = rows.groupBy(PART).cogroup(given.groupBy(PART)).applyInArrow(learn, "word string, state array<float>")
        wide = range(2 * size if epoch + 1 < epochs else size)  # the output side is of use to a later pass only
        state = durable(found.groupBy("word").agg(F.array(*[F.avg(F.col("state")[i]).cast("float") for i in wide]).alias("state")))
    return state.withColumnRenamed("state", "vector")


def mean_vectors(texts: DataFrame, vectors: DataFrame, size: int, schema) -> DataFrame:
    """Every row of ``texts`` with ``values``: the sum of its known words' vectors over the number of its words, 0 without words."""
    known = texts.select(F.col(PART).alias("_of"), F.explode(F.array_distinct(TOKENS)).alias("word")).distinct().join(vectors, "word")
    names = [f.name for f in schema.fields]

    def mean(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, row, lengths = _ids(left, right)
        held = _matrix(right["vector"], size)[ids].astype(np.float64)
        sums = [np.bincount(row, weights=held[:, i], minlength=left.num_rows) for i in range(size)]
        flat = (np.stack(sums, axis=1) / np.maximum(lengths, 1)[:, None]).ravel()
        offsets = pa.array(np.arange(left.num_rows + 1) * size, pa.int32())
        return left.select(names[:-1]).append_column("values", pa.ListArray.from_arrays(offsets, pa.array(flat)))

    return texts.groupBy(PART).cogroup(known.groupBy("_of")).applyInArrow(mean, schema)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(-1, width)


def _ids(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the known words of a part, in order: their places in ``right`` and their rows; and the words of each row, known or not."""
    lengths = pc.fill_null(pc.list_value_length(left[TOKENS]), 0).to_numpy().astype(np.int64)
    place = pc.index_in(pc.list_flatten(left[TOKENS]), value_set=right["word"].combine_chunks())
    ids = pc.fill_null(place, -1).to_numpy()
    row = np.repeat(np.arange(left.num_rows), lengths)
    return ids[ids >= 0], row[ids >= 0], lengths


def uniforms(seeds: np.ndarray, n: int) -> np.ndarray:
    """``n`` numbers in 0 to 1 of each seed that depend on it alone."""
    x = seeds.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def _start(seeds: np.ndarray, size: int) -> np.ndarray:
    """Uniform numbers within 0.5 / size that depend on a word's seed alone, so that all parts begin alike."""
    return ((uniforms(seeds, size) - 0.5) / size).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _move(vectors: np.ndarray, ids: np.ndarray, gradients: np.ndarray, weights: np.ndarray) -> None:
    """Add the gradients of each id, made smaller where their weights pass MOST_STEP, since all were taken at one place."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    total = np.add.reduceat(weights[order], firsts)
    vectors[ids[firsts]] += np.add.reduceat(gradients[order], firsts) * (MOST_STEP / np.maximum(total, MOST_STEP))[:, None]


def _learner(size: int, window: int, alpha: float, epoch: int, epochs: int, seed: int):
    """One pass over the texts of a part by negative sampling; a word's window is 1 to ``window`` wide, by chance."""

    def learn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by(ROW), right.sort_by("word")
        last = epoch + 1 == epochs
        if right["state"].null_count == right.num_rows:
            inner, outer = _start(right["seed"].to_numpy(), size), np.zeros((right.num_rows, size), dtype=np.float32)
        else:
            state = _matrix(right["state"], 2 * size)
            inner, outer = state[:, :size].copy(), state[:, size:].copy()
        ids, row, _ = _ids(left, right)
        rng = np.random.default_rng([seed % 2**32, epoch, key[0].as_py()])
        share = np.cumsum(right["n"].to_numpy().astype(np.float64) ** 0.75)
        reach = rng.integers(1, window + 1, len(ids))
        for a in range(0, len(ids), BLOCK):
            low, b = max(a - window, 0), min(a + BLOCK, len(ids))
            rate = np.float32(alpha * max(1.0 - (epoch + a / len(ids)) / epochs, 1e-4))
            noise = np.minimum(np.searchsorted(share, rng.random(NOISE) * share[-1], side="right"), len(share) - 1)
            _block(inner, outer, ids[low:b], row[low:b], reach[low:b], a - low, window, rate, noise)
        out = inner if last else np.concatenate([inner, outer], axis=1)
        offsets = pa.array(np.arange(right.num_rows + 1) * out.shape[1], pa.int32())
        return pa.table({"word": right["word"], "state": pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.float32()))})

    return learn


def _block(inner: np.ndarray, outer: np.ndarray, ids: np.ndarray, row: np.ndarray, reach: np.ndarray, first: int, window: int, rate: np.float32, noise: np.ndarray) -> None:
    """Train on all pairs whose later word is at ``first`` or after it; the words before it only serve as neighbours."""
    n = len(ids)
    u, v = np.ascontiguousarray(inner[ids].T), np.ascontiguousarray(outer[ids].T)
    du, dv = np.zeros_like(u), np.zeros_like(v)
    as_input, as_output = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
    for d in range(1, window + 1):
        at = max(first, d)
        if at >= n:
            break
        later, earlier = slice(at, n), slice(at - d, n - d)
        same = row[later] == row[earlier]
        for centre, other in ((later, earlier), (earlier, later)):  # the neighbour's vector foretells the word in the middle
            on = (same & (reach[centre] >= d)).astype(np.float32)
            pull = rate * on * (1.0 - _sigmoid((u[:, other] * v[:, centre]).sum(axis=0)))
            du[:, other] += pull * v[:, centre]
            dv[:, centre] += pull * u[:, other]
            as_input[other] += on
            as_output[centre] += on
    held = outer[noise]
    push = _sigmoid(held @ u) * (rate * np.float32(NEGATIVES / len(noise)) * as_input)
    du -= held.T @ push
    weight = np.full(len(noise), rate * np.float32(NEGATIVES / len(noise)) * as_input.sum(), dtype=np.float32)
    _move(inner, ids, du.T, rate * (1 + NEGATIVES) * as_input)
    _move(outer, np.r_[ids, noise], np.concatenate([dv.T, -(push @ u.T)]), np.r_[rate * as_output, weight])
