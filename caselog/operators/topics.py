"""Topics by online variational Bayes (Hoffman 2010) with the word table off the driver: no machine holds more than the words of one part of the texts.

The steps, priors and draws are those of Spark's own online LDA, which keeps a dense matrix of topics x words on the driver and in every task
instead. Documents are dealt into parts of bounded size and cut into counts of the part's own words once. A round joins the words that its
documents hold with the word table, finds the documents' topics part by part, and adds up what the parts say of a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.operators.skipgram import PART_BYTES, uniforms
from caselog.session import Workspace, clean_shuffles, durable

SHAPE = 100.0  # of the gamma draws that words and documents begin with; their mean is 1
OFFSET, DECAY = 1024.0, 0.51  # a round's weight is (OFFSET + round) ** -DECAY
CHANGE = 1e-3  # a document is done when its mean topic weight moves no more than this
BLOCK_CELLS = 1 << 18  # (document, word) cells worked on at once
LOG_SHARES, DOCUMENTS = -1, -2  # rows beside the words in what a part says: sums of the documents' log shares, and their number


def cut(docs: DataFrame, key: str, tokens: Column, text: str, space: Workspace, rounds: int = 0, share: float = 0.0, seed: int = 22) -> DataFrame:
    """Documents as counts of their part's words, and these words: one table of ``space``.

    A row of a document has (part, key, h, rounds, ids, counts), one of a word (part, id, word, df, n, rounds). ``h`` is a hash of the
    key; rows of equal keys are one document, documents without tokens have no row. ``rounds`` are the rounds of a fit that draw the
    document (``share`` of all in each, with replacement), or that meet the word.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    h = F.xxhash64(F.col(key), F.lit(seed))
    placed = docs.select(F.pmod(h, F.lit(parts)).cast("int").alias("part"), F.col(key).alias("key"), h.alias("h"), text).repartition(parts, "part")
    kind = placed.schema["key"].dataType.simpleString()
    schema = f"part int, key {kind}, h long, rounds array<int>, ids array<int>, counts array<int>, id int, word string, df long, n long"
    found = placed.select("part", "key", "h", tokens.alias("tokens")).groupBy("part").applyInArrow(_cutter(rounds, share, seed), schema)
    return space.table(found, "cut")


def _cutter(rounds: int, share: float, seed: int):
    def cut_part(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")
        lengths = pc.fill_null(pc.list_value_length(rows["tokens"]), 0).to_numpy().astype(np.int64)
        coded = pc.list_flatten(rows["tokens"]).combine_chunks().dictionary_encode()
        names, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        of = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        doc_of_cell = np.repeat(of, lengths).astype(np.int64)
        cells, counts = np.unique(doc_of_cell * max(len(names), 1) + ids, return_counts=True)
        doc, word = cells // max(len(names), 1), cells % max(len(names), 1)
        docs, starts = np.unique(doc, return_index=True)  # documents with tokens
        first = np.full(int(of.max(initial=-1)) + 1, -1)
        first[of[::-1]] = np.arange(len(of))[::-1]  # the first row of each key
        heads = first[docs]

        rng = np.random.default_rng([seed % 2**32, key[0].as_py()])
        times = rng.poisson(share * rounds, len(docs))
        drawn = rng.integers(0, max(rounds, 1), int(times.sum()))
        drawer = np.repeat(np.arange(len(docs)), times)
        order = np.lexsort((drawn, drawer))
        drawn, drawer = drawn[order], drawer[order]
        ends = np.r_[starts[1:], len(doc)]
        width = (ends - starts)[drawer]  # the words of each drawn document, by round
        at = np.repeat(starts[drawer] - np.r_[0, np.cumsum(width)[:-1]] if len(drawer) else [], width).astype(np.int64) + np.arange(int(width.sum()))
        met = np.unique(word[at] * max(rounds, 1) + np.repeat(drawn, width))
        met_word, met_round = met // max(rounds, 1), met % max(rounds, 1)

        n_docs, n_words = len(docs), len(names)
        lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))
        nulls = lambda n, kind: pa.nulls(n, kind)
        ints = pa.list_(pa.int32())
        part = key[0].cast(pa.int32())
        fields = {
            "part": pa.chunked_array([pa.repeat(part, n_docs), pa.repeat(part, n_words)]),
            "key": pa.chunked_array([rows["key"].combine_chunks().take(pa.array(heads)), nulls(n_words, rows["key"].type)]),
            "h": pa.chunked_array([rows["h"].combine_chunks().take(pa.array(heads)), nulls(n_words, pa.int64())]),
            "rounds": pa.chunked_array([lists(drawn, times), lists(met_round, np.bincount(met_word, minlength=n_words))]),
            "ids": pa.chunked_array([lists(word, ends - starts), nulls(n_words, ints)]),
            "counts": pa.chunked_array([lists(counts, ends - starts), nulls(n_words, ints)]),
            "id": pa.chunked_array([nulls(n_docs, pa.int32()), pa.array(np.arange(n_words), pa.int32())]),
            "word": pa.chunked_array([nulls(n_docs, names.type), names]),
            "df": pa.chunked_array([nulls(n_docs, pa.int64()), pa.array(np.bincount(word, minlength=n_words), pa.int64())]),
            "n": pa.chunked_array([nulls(n_docs, pa.int64()), pa.array(np.bincount(word, weights=counts, minlength=n_words).astype(np.int64))]),
        }
        return pa.table(fields)

    return cut_part


def documents(table: DataFrame) -> DataFrame:
    return table.filter("id is null").select("part", "key", "h", "rounds", "ids", "counts")


def known_words(table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(of, id, rounds, idx, df) of the parts' words that the dictionary has; ``of`` is the part. A word has a row per part, so none is frequent."""
    words = table.filter("id is not null").select(F.col("part").alias("of"), "id", "rounds", "word")
    return words.join(dictionary.select(F.col("term").alias("word"), F.col("idx").cast("int").alias("idx"), "df"), "word").drop("word")


def _columns(k: int) -> list[str]:
    return [f"t{i}" for i in range(k)]


def fit(table: DataFrame, dictionary: DataFrame, k: int, rounds: int, share: float, seed: int, idf_docs: int | None) -> tuple[DataFrame, list[float]]:
    """(idx, t0 ... t{k-1}) of every word of the dictionary, and the prior of each topic, after ``rounds`` rounds over the documents of ``cut``.

    ``idf_docs`` is the number of documents for tf-idf weights, None for plain counts.
    """
    t, alpha, eta = _columns(k), np.full(k, 1.0 / k), 1.0 / k
    with Workspace(table.sparkSession) as space:
        known = space.table(known_words(table, dictionary), "known")
        state = space.table(_begun(dictionary, k, seed), "words")
        docs = documents(table)
        size = _with_words(docs, known)
        batch = int(np.ceil(share * size))
        for r in range(rounds if size else 0):
            totals = _totals(state, k)
            mine = F.array_contains("rounds", r)
            given = known.filter(mine).select("of", "id", "idx", "df").join(state, "idx")
            learn = _learner(k, alpha, totals, r, seed, idf_docs)
            said = docs.filter(mine).select("part", "h", "rounds", "ids", "counts").groupBy("part").cogroup(given.groupBy("of"))
            said = said.applyInArrow(learn, "idx int, " + ", ".join(f"{c} double" for c in t))
            sums = space.table(said.groupBy("idx").agg(*[F.sum(c).alias(f"s_{c}") for c in t]), "sums")
            rest = {x["idx"]: np.array(x[1:]) for x in sums.filter("idx < 0").collect()}  # two rows
            n = rest[DOCUMENTS][0] if rest else 0.0
            if n:
                weight = (OFFSET + r + 1) ** -DECAY
                moved = state.join(sums, "idx", "left").select("idx", *[
                    (F.lit(1 - weight) * F.col(c) + F.lit(weight) * (F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) * F.lit(size / batch) + F.lit(eta))).alias(c) for c in t])
                moved = space.table(moved, "words")
                space.drop(state)
                state, alpha = moved, _moved_prior(alpha, rest[LOG_SHARES] / n, n, weight)
            space.drop(sums)
            clean_shuffles(table.sparkSession)
        return durable(state), [float(a) for a in alpha]


def _begun(dictionary: DataFrame, k: int, seed: int) -> DataFrame:
    def begin(batches):
        for b in batches:
            drawn = _gammas(b.column(1).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(drawn[:, i]) for i in range(k)]], ["idx", *_columns(k)])

    idx = F.col("idx").cast("int")
    return dictionary.select(idx.alias("idx"), F.xxhash64(idx, F.lit(seed)).alias("h")).mapInArrow(begin, "idx int, " + ", ".join(f"{c} double" for c in _columns(k)))


def _with_words(docs: DataFrame, known: DataFrame) -> int:
    """Documents with a word of the dictionary."""
    def count(key, left: pa.Table, right: pa.Table) -> pa.Table:
        place = _places(right)
        ids = pc.list_flatten(left["ids"]).to_numpy()
        row = np.repeat(np.arange(left.num_rows), pc.list_value_length(left["ids"]).to_numpy())
        return pa.table({"n": pa.array([len(np.unique(row[_place(place, ids) >= 0]))], pa.int64())})

    found = docs.select("part", "ids").groupBy("part").cogroup(known.select("of", "id").groupBy("of")).applyInArrow(count, "n long")
    return found.agg(F.sum("n")).first()[0] or 0


def _totals(state: DataFrame, k: int) -> np.ndarray:
    return np.array([x or 0.0 for x in state.agg(*[F.sum(c) for c in _columns(k)]).first()])


def shares(table: DataFrame, dictionary: DataFrame, topics: DataFrame, alpha: list[float], seed: int, idf_docs: int | None) -> DataFrame:
    """(key, shares) of every document of ``cut`` with a word of the dictionary."""
    k = len(alpha)
    given = known_words(table, dictionary).select("of", "id", "idx", "df").join(topics, "idx")
    docs = documents(table)
    infer = _inferrer(k, np.array(alpha), _totals(topics, k), seed, idf_docs)
    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("part", "key", "h", "ids", "counts").groupBy("part").cogroup(given.groupBy("of")).applyInArrow(infer, f"key {kind}, shares array<double>")


# --- inside a part ---------------------------------------------------------------------------------------------------


def _learner(k: int, alpha: np.ndarray, totals: np.ndarray, r: int, seed: int, idf_docs: int | None):
    def learn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("h")
        times = np.bincount(np.repeat(np.arange(left.num_rows), pc.list_value_length(left["rounds"]).to_numpy()),
                            weights=pc.list_flatten(left["rounds"]).to_numpy() == r, minlength=left.num_rows)
        beta = _beta(right, k, totals)
        sums, logs, n = np.zeros_like(beta), np.zeros(k), 0.0
        for rows, starts, word, weight in _blocks(left, right, idf_docs):
            start = _gammas(_mixed(left["h"].to_numpy()[rows], r), k)
            gamma, theta, left_over = _infer(start, alpha, beta[word], weight, starts)
            often = times[rows]
            cell = np.repeat(np.arange(len(rows)), np.diff(np.r_[starts, len(word)]))
            for i in range(k):
                sums[:, i] += np.bincount(word, weights=theta[cell, i] * left_over * often[cell], minlength=len(beta))
            logs += (often[:, None] * _expected_log(gamma)).sum(axis=0)
            n += often.sum()
        sums *= beta
        found = np.concatenate([sums, logs[None, :], np.full((1, k), n)])
        idx = np.r_[right["idx"].to_numpy(), LOG_SHARES, DOCUMENTS]
        return pa.table({"idx": pa.array(idx, pa.int32()), **{c: pa.array(found[:, i]) for i, c in enumerate(_columns(k))}})

    return learn


def _inferrer(k: int, alpha: np.ndarray, totals: np.ndarray, seed: int, idf_docs: int | None):
    def infer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("h")
        beta = _beta(right, k, totals)
        keys, found = [], []
        for rows, starts, word, weight in _blocks(left, right, idf_docs):
            gamma, _, _ = _infer(_gammas(_mixed(left["h"].to_numpy()[rows], -1), k), alpha, beta[word], weight, starts)
            keys.append(rows)
            found.append(gamma / gamma.sum(axis=1, keepdims=True))
        rows = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        flat = np.concatenate(found).ravel() if found else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(flat))
        return pa.table({"key": left["key"].take(pa.array(rows)), "shares": lists})

    return infer


def _places(right: pa.Table) -> np.ndarray:
    """Where in ``right`` the word of each id is; -1 without."""
    ids = right["id"].to_numpy()
    place = np.full(int(ids.max(initial=-1)) + 1, -1, dtype=np.int64)
    place[ids] = np.arange(len(ids))
    return place


def _place(place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(place):
        return np.full(len(ids), -1, dtype=np.int64)
    return np.where(ids < len(place), place[np.minimum(ids, len(place) - 1)], -1)


def _blocks(left: pa.Table, right: pa.Table, idf_docs: int | None):
    """(rows, starts, words, weights) of runs of documents: the rows with words, where each begins among the cells, the cells' places and weights."""
    place = _places(right)
    lengths = pc.list_value_length(left["ids"]).to_numpy().astype(np.int64)
    word = _place(place, pc.list_flatten(left["ids"]).to_numpy())
    weight = pc.list_flatten(left["counts"]).to_numpy().astype(np.float64)
    row = np.repeat(np.arange(left.num_rows), lengths)
    held = word >= 0
    word, weight, row = word[held], weight[held], row[held]
    if idf_docs is not None:
        weight = weight * np.log2(idf_docs / right["df"].to_numpy()[word])
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=left.num_rows))[row]
        weight = np.divide(weight, norm, out=weight, where=norm > 0)
        held = weight != 0
        word, weight, row = word[held], weight[held], row[held]
    rows, starts = np.unique(row, return_index=True)
    ends = np.r_[starts[1:], len(row)]
    a = 0
    while a < len(rows):
        b = max(int(np.searchsorted(ends, starts[a] + BLOCK_CELLS, side="right")), a + 1)
        yield rows[a:b], starts[a:b] - starts[a], word[starts[a]:ends[b - 1]], weight[starts[a]:ends[b - 1]]
        a = b


def _infer(gamma: np.ndarray, alpha: np.ndarray, beta: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topic weights of the documents of a block, their exponential expected logs, and each cell's weight over its likelihood."""
    gamma = gamma.copy()
    theta = np.exp(_expected_log(gamma))
    sizes = np.diff(np.r_[starts, len(weight)])
    out_rest = np.empty(len(weight))
    docs, cells, b, w, s, n = np.arange(len(gamma)), np.arange(len(weight)), beta, weight, starts, sizes
    rest = w / (np.einsum("ij,ij->i", b, np.repeat(theta, n, axis=0)) + 1e-100)
    while len(docs):
        moved = theta[docs] * np.add.reduceat(b * rest[:, None], s, axis=0) + alpha
        change = np.abs(moved - gamma[docs]).mean(axis=1)
        gamma[docs], theta[docs] = moved, np.exp(_expected_log(moved))
        rest = w / (np.einsum("ij,ij->i", b, np.repeat(theta[docs], n, axis=0)) + 1e-100)
        done = change <= CHANGE
        if done.any():
            cell_done = np.repeat(done, n)
            out_rest[cells[cell_done]] = rest[cell_done]
            docs, n, cells, b, w, rest = docs[~done], n[~done], cells[~cell_done], b[~cell_done], w[~cell_done], rest[~cell_done]
            s = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
    return gamma, theta, out_rest


def _beta(right: pa.Table, k: int, totals: np.ndarray) -> np.ndarray:
    """exp(E[log]) of the words' shares in each topic."""
    state = np.stack([right[c].to_numpy() for c in _columns(k)], axis=1)
    return np.exp(digamma(state) - digamma(totals))


def _expected_log(gamma: np.ndarray) -> np.ndarray:
    return digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))


def _moved_prior(alpha: np.ndarray, log_shares: np.ndarray, n: float, weight: float) -> np.ndarray:
    """A Newton step of the topics' priors; one that leaves a prior of 0 or less is not taken."""
    gradient = n * (-(digamma(alpha) - digamma(alpha.sum())) + log_shares)
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (gradient / q).sum() / (1.0 / c + (1.0 / q).sum())
    moved = alpha + weight * -(gradient - b) / q
    return moved if (moved > 0).all() else alpha


def digamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    # x (x + 1) ... (x + 5) in pairs: the sum of six reciprocals by three divisions
    a, b, c = x * (x + 5), (x + 1) * (x + 4), (x + 2) * (x + 3)
    y = x + 6
    f = 1.0 / (y * y)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132 - f * (691 / 32760 - f / 12))))))
    return np.log(y) - 0.5 / y - series - (2 * x + 5) * (1 / a + 1 / b + 1 / c)


def trigamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    early = sum(1.0 / (x + i) ** 2 for i in range(6))
    y = x + 6
    f = 1.0 / (y * y)
    return early + 1 / y + f / 2 + f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66))))


def _mixed(h: np.ndarray, r: int) -> np.ndarray:
    return h.astype(np.uint64) + np.uint64((r + 2) * 0xD1B54A32D192ED03 % 2**64)


def _gammas(seeds: np.ndarray, k: int) -> np.ndarray:
    """Draws of mean 1 from Gamma(SHAPE, 1 / SHAPE) that depend on a seed alone (Wilson-Hilferty: the cube of a normal draw)."""
    u = uniforms(seeds, 2 * k)
    z = np.sqrt(-2.0 * np.log1p(-u[:, :k])) * np.cos(2.0 * np.pi * u[:, k:])
    return (1.0 - 1.0 / (9.0 * SHAPE) + z / (3.0 * np.sqrt(SHAPE))) ** 3
