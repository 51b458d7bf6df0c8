"""Toxic documents and their offending sentences by multiple-instance learning.

Only documents carry labels. A sentence has a logistic score on its words; a document's score is the noisy-or of its
sentences, 1 - prod(1 - p). A word weighs the sum of what its parts weigh (the word, its beginnings and endings, hashed), so
inflected forms share what was learned. The weights are trained through the noisy-or from the document labels: the
sentences that make a document toxic are found without ever being labelled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrow import Batches, Cache, list_array, list_rows, sliced
from caselog.llm.labelled import training_rows

SPACE = 1 << 18
MOST_ROWS = 12_000
LEAST_ROWS_OF_PART = 5
PASSES = 30
RATE = 0.1
DECAY = 1e-4
START_BIAS = -9.0
THRESHOLD = 0.5

#: words, or the end of a sentence (a full stop, mark or line break with what follows of them)
PART = re.compile(r"[^\W_]+|[.!?\n]+")


def word_parts(word: str) -> list[int]:
    """Hashes of the word, its beginnings of three to six letters and its endings of three to five."""
    found = {f"={word}"} | {f"^{word[:n]}" for n in range(3, 7)} | {f"{word[-n:]}$" for n in range(3, 6)}
    return [xxhash.xxh3_64_intdigest(f) & (SPACE - 1) for f in sorted(found)]


def _word_ids(parts: list[str]) -> list[int]:
    """63-bit word hash, or -1 for the end of a sentence."""
    return [xxhash.xxh3_64_intdigest(p) >> 1 if p[0] not in ".!?\n" else -1 for p in parts]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float
    base: float | None = None  # the score of every text when one class was missing

    def cache(self) -> Cache:
        """Weight of each word met by a task; nan for the end of a sentence."""
        return Cache(lambda parts: [float("nan") if p[0] in ".!?\n" else float(self.weights[word_parts(p)].sum()) for p in parts])

    def sentences(self, text: str | None, cache: Cache) -> np.ndarray:
        """Log-odds of each sentence that has a word."""
        parts = PART.findall((text or "").lower())
        w = np.array(cache.values(parts), dtype=float)
        end = np.isnan(w)
        if end.all():
            return np.empty(0)
        place = np.unique(np.cumsum(end)[~end], return_inverse=True)[1]
        return np.bincount(place, weights=w[~end]) + self.bias

    def score(self, text: str | None, cache: Cache) -> float:
        if self.base is not None:
            return self.base
        return float(-np.expm1(-_softplus(self.sentences(text, cache)).sum()))


def _features(batches: Batches) -> Batches:
    """Words of the sampled texts as hashes; the first row of a batch has the batch's distinct words beside it."""
    cache = Cache(_word_ids)
    for batch in sliced(batches, 1):
        texts = [PART.findall(t.lower()) for t in batch.column(1).to_pylist()]
        rows = [np.array(cache.values(t), dtype=np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(rows, pa.int64()), batch.column(2), pa.array([sorted({p for t in texts for p in t}), *[[]] * (len(texts) - 1)], pa.list_(pa.string()))],
                                         names=["id", "f", "y", "words"])


def parts_table(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes ascending, where each word's parts begin, parts), in flat arrays."""
    ids = np.array(_word_ids(names), dtype=np.int64)
    order = np.argsort(ids)
    flat, begins = array("i"), array("q", [0])
    for i in order.tolist():
        flat.extend(word_parts(names[i]))
        begins.append(len(flat))
    return ids[order], np.array(begins), np.array(flat, dtype=np.int32)


def train_noisy_or(rows: list[np.ndarray], y: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> ToxicModel:
    """Adagrad on the documents' log-likelihood; only word parts of several documents get a weight."""
    flat = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sentence = np.cumsum((flat < 0) | np.concatenate([[False], doc[1:] != doc[:-1]]))
    keep = flat >= 0
    doc, sentence = doc[keep], np.unique(sentence[keep], return_inverse=True)[1]
    words, starts, part = table
    place = np.searchsorted(words, flat[keep]).astype(np.int32)
    del flat
    n = int(sentence[-1]) + 1
    owner = np.zeros(n, dtype=np.int64)
    owner[sentence] = doc
    # parts that several documents hold; a document counts once for a part
    of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
    pairs = np.unique(doc.astype(np.int64) * len(words) + place)
    held, held_toxic = np.zeros(SPACE), np.zeros(SPACE)
    owners = np.unique(pairs // len(words))
    for at, d in zip(owners, np.split(pairs % len(words), np.flatnonzero(np.diff(pairs // len(words))) + 1)):
        own = np.unique(np.concatenate([part[starts[w] : starts[w + 1]] for w in d.tolist()]))
        held[own] += 1
        held_toxic[own] += y[at] > 0
    usable = held[part] >= LEAST_ROWS_OF_PART
    part, of = part[usable], of[usable]
    # start: how far a part's log odds ratio is surely above zero (two standard errors), split over a word's parts
    toxic_docs, clean_docs = float((y > 0).sum()), float((y <= 0).sum())
    clean = held - held_toxic
    ratio = np.log((held_toxic + 0.5) / (toxic_docs + 1)) - np.log((clean + 0.5) / (clean_docs + 1))
    error = np.sqrt(1 / (held_toxic + 0.5) + 1 / (clean + 0.5))
    w, g2 = np.where(held >= LEAST_ROWS_OF_PART, np.maximum(ratio - 2 * error, 0.0), 0.0), np.full(SPACE, 1e-6)
    bias, gb2 = START_BIAS, 1e-6
    for _ in range(PASSES):
        of_word = np.bincount(of, weights=w[part], minlength=len(words))
        z = np.bincount(sentence, weights=of_word[place], minlength=n) + bias
        total = np.bincount(owner, weights=_softplus(z), minlength=len(rows))
        toxic = np.maximum(-np.expm1(-total), 1e-12)
        pull = np.where(y > 0, -(1 - toxic) / toxic, 1.0)  # d loss / d softplus
        gz = pull[owner] * np.exp(-_softplus(-z)) / len(rows)
        g_word = np.bincount(place, weights=gz[sentence], minlength=len(words))
        gw, gb = np.bincount(part, weights=g_word[of], minlength=SPACE) + DECAY * w, gz.sum()
        g2 += gw * gw
        gb2 += gb * gb
        w -= RATE * gw / np.sqrt(g2)
        bias -= RATE * gb / np.sqrt(gb2)
    return ToxicModel(w.astype(np.float32), float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                 most_rows: int = MOST_ROWS) -> ToxicModel:
    """Fit on about ``most_rows`` labelled rows outside the held-out fold. With one class only, every text scores that class's share."""
    sample = training_rows(docs, labels, label, id_col, text_col, most_rows).mapInArrow(_features, "id long, f array<long>, y int, words array<string>")
    sample = sample.toArrow().combine_chunks()
    rows = [r for chunk in sample["f"].chunks for r in list_rows(chunk)]
    y = (sample["y"].to_numpy() > 0).astype(float) if rows else np.empty(0)
    order = np.argsort(np.nan_to_num(sample["id"].to_numpy().astype(float)), kind="stable")
    rows, y = [rows[i] for i in order], y[order]
    if len(set(y.tolist())) < 2 or not sum(len(r) for r in rows):
        return ToxicModel(np.zeros(SPACE, dtype=np.float32), 0.0, base=float(y.mean()) if len(y) else 0.0)
    words = set(w for chunk in sample["words"].chunks for w in chunk.values.to_pylist() if w[0] not in ".!?\n")
    return train_noisy_or(rows, y, parts_table(sorted(words)))


def toxicity_score(model: ToxicModel, text_col: str = "text") -> Column:
    """Noisy-or score of a whole text; a text without words has no sentence and scores 0."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = model.cache()
        for part in parts:
            yield pd.Series([model.score(t, cache) for t in part], dtype="float64")

    return score(F.col(text_col))


def carrying(sentences: list[tuple[float, int, int]], threshold: float) -> list[tuple[float, int, int]]:
    """The fewest (log-odds, start, end) without which the others stay below ``threshold`` under noisy-or, in text order; at least one."""
    ranked = sorted(sentences, key=lambda s: (-s[0], s[1]))
    rest = np.cumsum(_softplus(np.array([s[0] for s in ranked]))[::-1])[::-1]  # of each sentence and those after it
    n = max(1, int((-np.expm1(-rest) >= threshold).sum()))
    return sorted(ranked[:n], key=lambda s: s[1])


SPANS = "array<struct<start:int,end:int,score:double>>"


def judged(model: ToxicModel, text_col: str = "text", threshold: float = THRESHOLD) -> Column:
    """Score of a whole text, and the sentences that carry it to ``threshold``: code point places (end exclusive) and score.

    Sentences are taken by descending score until the rest, under noisy-or, falls below ``threshold``.
    """

    @F.pandas_udf(f"score double, sentences {SPANS}")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = model.cache()
        for part in parts:
            scores, out = [], []
            for text in part:
                scores.append(model.score(text, cache))
                found = []
                if text and scores[-1] >= threshold:
                    start = 0
                    for stop in [m.start() for m in re.finditer(r"[.!?\n]+", text)] + [len(text)]:
                        z = model.sentences(text[start:stop], cache)
                        if len(z):
                            found.append((float(z[0]), start, stop))
                        start = stop
                out.append([{"start": a, "end": b, "score": float(1 / (1 + np.exp(-z)))} for z, a, b in carrying(found, threshold)])
            yield pd.DataFrame({"score": scores, "sentences": out})

    return both(F.col(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                   sentences: bool = True, out: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1, ``predicted`` (1 from ``threshold`` on) and, if asked, ``sentences``.

    The score depends on the text alone. Columns of the new names are replaced, others kept; null and empty texts
    score 0 (or the constant of a model without both classes) and have no sentences.
    """
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    if not sentences:
        return docs.withColumn(out, toxicity_score(model, text_col)).withColumn("predicted", (F.col(out) >= threshold).cast("int"))
    scored = docs.withColumn("_judged", judged(model, text_col, threshold)).withColumn(out, F.col("_judged.score")).withColumn("sentences", F.col("_judged.sentences"))
    return scored.withColumn("predicted", (F.col(out) >= threshold).cast("int")).drop("_judged")
