"""Document quality by naive Bayes support vectors.

Documents become indicators of n-grams: words and word pairs in lower case, and runs of one to three token shapes
(case, digits, symbols, repeats of the token before), hashed to a fixed space. Each indicator is scaled by the log ratio
of its smoothed counts in the two classes; a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent and mixed with the plain ratios. A logistic curve fitted on rows left out of the descent turns
margins into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrow import Batches, Cache, list_array, list_rows, sliced
from caselog.llm.labelled import training_rows

SPACE = 1 << 20
MOST_ROWS = 12_000
COST = 0.1
PASSES = 12
MIX = 0.25
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_ODD = np.array([xxhash.xxh3_64_intdigest(f"gram {i}") | 1 for i in range(6)], dtype=np.uint64)


def _shape(token: str) -> str:
    if not token[0].isalnum():
        return token[:1] + ("+" if len(token) > 1 else "")
    if token.isdigit():
        return "9"
    if token.isupper():
        return "X" if len(token) > 1 else "x1"
    return "Xx" if token[0].isupper() else "x"


def _describe(tokens: list[str]) -> list[tuple[int, int]]:
    """Hash of the lowered token and of its shape."""
    return [(xxhash.xxh3_64_intdigest("w" + t.lower()), xxhash.xxh3_64_intdigest("s" + _shape(t))) for t in tokens]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    return (h >> np.uint64(44)).astype(np.int32)


def grams(text: str | None, cache: Cache) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, ascending; empty for texts without a token."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, dtype=np.int32)
    both = np.array(cache.values(tokens), dtype=np.uint64)
    word, shape = both[:, 0], both[:, 1].copy()
    again = np.concatenate([[False], word[1:] == word[:-1]])
    shape[again] ^= _ODD[5]
    found = [_mixed(word * _ODD[0]), _mixed(shape * _ODD[1])]
    if len(tokens) > 1:
        found += [_mixed(word[:-1] * _ODD[2] + word[1:] * _ODD[3]), _mixed(shape[:-1] * _ODD[3] + shape[1:] * _ODD[4])]
    if len(tokens) > 2:
        found.append(_mixed(shape[:-2] * _ODD[0] + shape[1:-1] * _ODD[2] + shape[2:] * _ODD[4]))
    return np.unique(np.concatenate(found))


@dataclass
class QualityModel:
    weights: np.ndarray  # one per hashed n-gram; all zero when one class was missing
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum()) / max(1.0, len(features)) ** 0.5 + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, passes: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights on the scaled indicators (rows divided by the root of their length), and the bias.

    Minimises |w|^2 / 2 + cost * sum(max(0, 1 - y w.x)) one dual variable at a time; classes weigh alike in sum.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    root = np.array([max(1.0, len(r)) ** 0.5 for r in rows])
    square = np.array([(ratio[r] ** 2).sum() for r in rows]) / root**2 + 1
    alpha = np.zeros(len(rows))
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            r = rows[i]
            slope = y[i] * ((w[r] * ratio[r]).sum() / root[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * ratio[r] / root[i]
                bias += step
                alpha[i] = new
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps; targets a little inside 0 and 1."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        beta += np.clip(np.linalg.solve(hessian, x.T @ (target - p)), -5, 5)
    return float(max(beta[0], 1e-3)), float(beta[1])


def _features(batches: Batches) -> Batches:
    cache = Cache(_describe)
    for batch in sliced(batches, 1):
        rows = [grams(t, cache) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(rows, pa.int32()), batch.column(2)], names=["id", "f", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                most_rows: int = MOST_ROWS) -> QualityModel:
    """Fit on about ``most_rows`` labelled rows outside the held-out fold (n-grams are made by the executors).

    Without rows of both classes the model scores every text alike: the share of ones, or 0.5 without labels.
    """
    sample = training_rows(docs, labels, label, id_col, text_col, most_rows).mapInArrow(_features, "id long, f array<int>, y int").toArrow().combine_chunks()
    order = np.argsort(np.nan_to_num(sample["id"].to_numpy().astype(float)), kind="stable")
    rows = [r for chunk in sample["f"].chunks for r in list_rows(chunk)]
    rows, y = [rows[i] for i in order], np.where(sample["y"].to_numpy()[order] > 0, 1, -1) if len(order) else np.empty(0)
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).mean()) * 0.998 + 0.001) if len(y) else 0.5
        return QualityModel(np.zeros(SPACE, dtype=np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    calibrate = np.arange(len(y)) % 5 == 4 if min((y > 0).sum(), (y < 0).sum()) >= 25 else np.zeros(len(y), bool)
    fit = ~calibrate
    counts = [np.ones(SPACE), np.ones(SPACE)]
    for r, target in zip((rows[i] for i in np.flatnonzero(fit)), y[fit]):
        counts[int(target > 0)][r] += 1
    seen = (counts[0] + counts[1]) >= 5  # an n-gram of one or two rows says nothing
    ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
    w, bias = dual_descent([rows[i] for i in np.flatnonzero(fit)], y[fit], ratio, COST, PASSES)
    w = (1 - MIX) * np.abs(w).sum() / max(1, np.count_nonzero(w)) + MIX * w
    weights, bias = (w * ratio).astype(np.float32), MIX * bias
    use = calibrate if calibrate.any() else fit
    margins = np.array([weights[rows[i]].sum() / max(1.0, len(rows[i])) ** 0.5 + bias for i in np.flatnonzero(use)])
    return QualityModel(weights, bias, *_logistic(margins, y[use]))


def quality_score(model: QualityModel, text_col: str = "text") -> Column:
    """Score column of a whole text; null and empty texts get the score of no evidence."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = Cache(_describe)
        for part in parts:
            yield pa.array([model.score(grams(t.as_py(), cache)) for t in part], pa.float64())

    return score(F.col(text_col))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  out: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1 and ``predicted``, 1 from ``threshold`` on.

    The score depends on the text alone. Columns of the two new names are replaced, all others kept; null, empty and
    repeated rows are scored like any other text.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    return docs.withColumn(out, quality_score(model, text_col)).withColumn("predicted", (F.col(out) >= threshold).cast("int"))
