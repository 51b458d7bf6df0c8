"""SentencePiece encoding and decoding: the best path of a unigram model.

A text is a marker for its start and one for each blank, so every marker begins a unit; the pieces of the best path never
cross units. Pieces lie in a double array over UTF-8 bytes: from state s a byte b leads to base[s] + b, if check there
names s. All units of a batch are walked in step, position by position, and the best score of every prefix is kept
(Viterbi); tasks keep the paths of units they have met. Characters that no piece covers become byte pieces, and decoding
turns byte pieces and markers back, so every text returns exactly.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.llm.arrow import Batches, Cache, list_array, list_rows, sliced

MARK = "▁"
UNIT = re.compile(f"[\n{MARK}]| ?[^ \n{MARK}]+| ")
UNKNOWN_PENALTY = 10.0
LONG_UNIT = 160
CHUNK = 4096
WINDOW = 1024


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): value is the key's number at the state where it ends, else -1. The root is state 0."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for number, key in enumerate(keys):
        at = 0
        for b in key:
            if b not in tree[at]:
                tree[at][b] = len(tree)
                tree.append({})
                ends.append(-1)
            at = tree[at][b]
        ends[at] = number
    size = 2 * len(tree) + 2048
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0], check[0] = True, 0
    todo, free, state_of = [0], 1, {0: 0}
    while todo:  # level by level, nodes with many children first
        after = []
        for node in sorted(todo, key=lambda n: -len(tree[n])):
            state = state_of[node]
            value[state] = ends[node]
            kids = sorted(tree[node])
            if not kids:
                continue
            while used[free]:
                free += 1
            start = max(1, free - kids[0])
            while True:
                if start + WINDOW + 256 > len(used):
                    base, check, value, used = (np.concatenate([x, np.full(len(x), f, x.dtype)]) for x, f in ((base, 0), (check, -1), (value, -1), (used, False)))
                open_ = ~used[start + kids[0] : start + kids[0] + WINDOW]
                for k in kids[1:]:
                    open_ &= ~used[start + k : start + k + WINDOW]
                if open_.any():
                    start += int(open_.argmax())
                    break
                start += WINDOW
            base[state] = start
            for k in kids:
                used[start + k], check[start + k] = True, state
                state_of[tree[node][k]] = start + k
            after += tree[node].values()
        todo = after
    top = int(np.flatnonzero(used)[-1]) + 257
    return tuple(np.concatenate([x, np.full(257, f, np.int32)])[:top].copy() for x, f in ((base, 0), (check, -1), (value, -1)))


@dataclass
class Pieces:
    """A vocabulary ready to encode: the double array, scores and ids of pieces, ids and bytes for the way back."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]
    unknown: float
    longest: int

    @classmethod
    def load(cls, model_path: str) -> Pieces:
        """From a model file with byte fallback. A unigram model keeps its log scores; one of merges has ranks, which
        become log shares under Zipf's law. Pieces with a marker after the first character can't be on a path."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        names, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        plain = [i for i in plain if MARK not in names[i][1:] and "\n" not in names[i] and (scores[i] > -1e8 or len(names[i]) == 1)]
        if (scores[plain] == np.round(scores[plain])).all():
            ranks = np.argsort(np.argsort(-scores[plain], kind="stable"), kind="stable")
            scores[plain] = -np.log(ranks + 1) - math.log(sum(1 / (r + 1) for r in range(len(plain))))
        byte_ids = np.full(256, -1, np.int32)
        surface = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(names[i][1:-1], 16)] = i
                surface[i] = bytes([int(names[i][1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                surface[i] = names[i].replace(MARK, " ").encode()
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        keys = [names[i].encode() for i in plain]
        base, check, value = double_array(keys)
        return cls(base, check, value, scores[plain], np.array(plain, np.int32), byte_ids, surface,
                   float(scores[plain].min()) - UNKNOWN_PENALTY, max(map(len, keys)))

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text) if text else []

    def _bytes(self, unit: str) -> bytes:
        return (MARK + unit[1:] if unit[0] == " " else unit).encode()

    def paths(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as 32-bit numbers in bytes. A literal marker or line break is written in byte pieces."""
        out: list[bytes] = [b""] * len(units)
        short = []
        for i, u in enumerate(units):
            if u in (MARK, "\n"):
                out[i] = self.byte_ids[np.frombuffer(u.encode(), np.uint8)].tobytes()
            else:
                b = self._bytes(u)
                if len(b) > LONG_UNIT:
                    out[i] = self._one(b)
                else:
                    short.append((len(b), i, b))
        short.sort()
        for a in range(0, len(short), CHUNK):
            part = short[a : a + CHUNK]
            for (_, i, _), path in zip(part, self._many([b for _, _, b in part])):
                out[i] = path
        return out

    def _trace(self, data: bytes, back: list[int], piece: list[int]) -> bytes:
        ids, at = [], len(data)
        while at:
            start = back[at]
            ids.append(self.ids[piece[at]].tobytes() if piece[at] >= 0 else self.byte_ids[np.frombuffer(data[start:at], np.uint8)].tobytes())
            at = start
        return b"".join(reversed(ids))

    def _one(self, data: bytes) -> bytes:
        """The best path of one long unit; memory and time follow its length."""
        n = len(data)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self._lists()
        for s in range(n):
            here = best[s]
            if here == -math.inf:
                continue
            size = _char_size(data[s])
            state, single = 0, False
            for e in range(s, n):
                after = base[state] + data[e]
                if check[after] != state or after == 0:
                    break
                state = after
                v = value[state]
                if v >= 0:
                    single |= e + 1 - s == size
                    if here + score[v] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = here + score[v], s, v
            if not single and here + self.unknown > best[s + size]:
                best[s + size], back[s + size], piece[s + size] = here + self.unknown, s, -1
        return self._trace(data, back, piece)

    def _lists(self):
        if not hasattr(self, "_kept"):
            self._kept = tuple(a.tolist() for a in (self.base, self.check, self.value, self.score))
        return self._kept

    def _many(self, data: list[bytes]) -> list[bytes]:
        n, lengths = len(data), np.array([len(b) for b in data])
        wide = int(lengths.max())
        grid = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in data), np.uint8).reshape(n, wide).astype(np.int32)
        best = np.full((n, wide + 5), -np.inf)
        best[:, 0] = 0.0
        back, piece = np.zeros((n, wide + 5), np.int16), np.full((n, wide + 5), -1, np.int32)
        lead = np.array([_char_size(b) for b in range(256)])
        for s in range(wide):
            rows = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            sizes, single = lead[grid[rows, s]], np.zeros(len(rows), bool)
            state, alive = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for e in range(s, min(wide, s + self.longest)):
                at = rows[alive]
                inside = lengths[at] > e
                alive, at = alive[inside], at[inside]
                after = self.base[state[alive]] + grid[at, e]
                going = (self.check[after] == state[alive]) & (after > 0)
                alive, at, after = alive[going], at[going], after[going]
                if not len(alive):
                    break
                state[alive] = after
                v = self.value[after]
                ends = v >= 0
                if ends.any():
                    who, at, v = alive[ends], at[ends], v[ends]
                    single[who] |= sizes[who] == e + 1 - s
                    total = best[at, s] + self.score[v]
                    better = total > best[at, e + 1]
                    at, v = at[better], v[better]
                    best[at, e + 1], back[at, e + 1], piece[at, e + 1] = total[better], s, v
            lone = ~single
            at, stop = rows[lone], s + sizes[lone]
            total = best[at, s] + self.unknown
            better = total > best[at, stop]
            at, stop = at[better], stop[better]
            best[at, stop], back[at, stop], piece[at, stop] = total[better], s, -1
        return [self._trace(b, r, p) for b, r, p in zip(data, back.tolist(), piece.tolist())]

    def encode(self, texts: list[str], cache: Cache) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(paths), dtype=np.int32) for paths in cache.rows([self.units(t) for t in texts])]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _char_size(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _with(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode_pieces(docs: DataFrame, pieces: Pieces, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text. Null texts have null ids, empty ones none. Repeated rows are
    encoded row by row; other columns pass through, one named ``out`` is replaced."""
    given = docs.drop(out)
    at = given.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        cache = Cache(pieces.paths)
        for batch in sliced(batches, at):
            texts = batch.column(at).to_pylist()
            ids = list_array(pieces.encode([t or "" for t in texts], cache), pa.int32())
            if any(t is None for t in texts):
                ids = pa.array([None if t is None else x for t, x in zip(texts, ids.to_pylist())], pa.list_(pa.int32()))
            yield _with(batch, ids, out)

    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_pieces(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each id list; null lists give null. Ids outside the vocabulary raise."""
    given = rows.drop(out)
    at = given.columns.index(ids_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column(at)
            if batch.num_rows:
                texts = [pieces.decode(r.tolist()) for r in list_rows(column)]
                if column.null_count:
                    texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())]
                yield _with(batch, pa.array(texts, pa.string()), out)

    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField(out, T.StringType())]))


def token_counts(rows: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """``rows`` with n_tokens and n_byte_tokens, the latter counted by the ids of byte pieces."""
    lo, hi = int(pieces.byte_ids.min()), int(pieces.byte_ids.max())
    if hi - lo != 255:
        raise ValueError("byte pieces must be consecutive")
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return rows.withColumns({"n_tokens": F.size(ids).cast("long"), "n_byte_tokens": F.size(F.filter(ids, lambda i: i.between(lo, hi))).cast("long")})
