"""Token ids in Parquet, readable by column and by document.

Layout of a written folder: ``ids`` holds one row per document, in ascending order of its id over the files, with the
columns part, doc_id, start_in_part, n_tokens (delta encoded: no dictionary, format v2) and ids (a list, dictionary
encoded); ``parts`` holds one row per file: its number, tokens and the tokens of all files before it. Row groups and pages
are small enough for page indexes to skip: a reader that filters on doc_id opens only the pages that can hold it, and
one that wants lengths or places never touches the ids.

Text is encoded by the tokenizers library. Chunks (a blank after a non-blank begins one) can't share a token with their
neighbours, so a worker keeps the ids of the chunks it has met and hands only new ones to the library, strung together
and parted again by the bytes that each id stands for.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselog.llm.arrow import Batches, Cache, list_array, list_rows, sliced

END_ID = 2
_AFTER_BLANK = re.compile(r"\s ")
_PLAIN = re.compile(r" \S+\Z")
_ODD = r"[\s\pZ\x0b\x1c-\x1f\x{85}] "  # _AFTER_BLANK for Arrow, whose \s is that of ASCII
STRING = 4096
JOINED = 64  # chunks in one string for the library, which is slower on longer ones
_CUT = re.compile(r"(?<=\S)(?= )")
_FORMAT = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000", "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#part": "false", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def chunks(text: str) -> list[str]:
    """The text cut before each blank that follows a non-blank; joined they are the text."""
    if _AFTER_BLANK.search(text) or text.startswith(" "):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]] if first or rest else []


class Encoder:
    """Ids of chunks as bytes, by one tokenizer."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in added):
            raise ValueError("an added token holds a blank, so texts can't be cut at blanks")
        # the library cuts texts at added tokens; chunks with one are encoded by themselves
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # byte-level: a letter of a piece is a byte
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(piece)

    def __call__(self, new: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        plain = [c for c in new if _PLAIN.match(c)]
        if self.added.search("".join(plain)):
            plain = [c for c in plain if not self.added.search(c)]
        for at in range(0, len(plain), STRING):
            part = plain[at : at + STRING]
            strings = ["".join(part[i : i + JOINED]) for i in range(0, len(part), JOINED)]
            # the fast call gives the same ids, without places in the text
            encoded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
            ids = np.array([i for e in encoded for i in e.ids], dtype="<u4")
            ends = np.cumsum([len(c.encode()) for c in part])
            reached = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(reached, ends)
            if (reached[np.minimum(cuts, len(reached) - 1)] == ends).all():  # every chunk ends where a token does
                data, stops = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
                out.update((c, data[a:b]) for c, a, b in zip(part, stops, stops[1:]))
        rest = [c for c in new if c not in out]
        out.update(zip(rest, (np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        return [out[c] for c in new]


_encoders: dict[str, Cache] = {}


def encoder(tokenizer_path: str) -> Cache:
    """The worker's cache for a tokenizer; it serves all tasks of the worker."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Cache(Encoder(tokenizer_path))
    return _encoders[tokenizer_path]


def _split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunks of texts cut at every blank, each different one once; the place of each chunk of the texts among them; chunks per text."""
    pieces = pc.split_pattern(texts, " ")
    ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    coded = pieces.flatten().dictionary_encode()
    places, different = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begins = [different[i] for i in places[firsts].tolist()]  # a text's first chunk has no blank before it
    places[firsts] = len(different) + np.arange(len(firsts))
    return [" " + p for p in different] + begins, places, ends


def _ids(cache: Cache, texts: pa.Array, end: bytes) -> list[np.ndarray]:
    """The ids of every text, with the end id. Texts with a blank at their beginning or after a blank are cut one by one."""
    odd = pc.or_(pc.starts_with(texts, " "), pc.match_substring_regex(texts, _ODD)).to_numpy(zero_copy_only=False)
    rows: list = [None] * len(texts)
    for i, found in zip(np.flatnonzero(odd), cache.rows([chunks(t) for t in texts.filter(pa.array(odd)).to_pylist()])):
        rows[i] = np.frombuffer(b"".join(found) + end, dtype=np.int32)
    even = np.flatnonzero(~odd)
    if len(even):
        different, places, ends = _split(texts.filter(pa.array(~odd)))
        found = [*cache.values(different), end]
        places, last = np.insert(places, ends, len(different)), ends + np.arange(1, len(ends) + 1)  # a text ends with the end id
        sizes = np.array(list(map(len, found)), dtype=np.int64) // 4
        starts, lengths = np.cumsum(sizes) - sizes, sizes[places]
        upto = np.cumsum(lengths)
        ids = np.frombuffer(b"".join(found), dtype=np.int32)[np.repeat(starts[places] - (upto - lengths), lengths) + np.arange(upto[-1])]
        cuts = [0, *upto[last - 1].tolist()]
        for i, a, b in zip(even, cuts, cuts[1:]):
            rows[i] = ids[a:b]
    return rows


def _encode(tokenizer_path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Batches) -> Batches:
        cache, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in sliced(batches, 1):
            rows = _ids(cache, pc.fill_null(batch.column(1), ""), end)
            sizes = np.array([len(r) for r in rows], dtype=np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part), pa.int32()), batch.column(0), pa.array(starts), pa.array(sizes), list_array(rows, pa.int32())],
                names=["part", "doc_id", "start_in_part", "n_tokens", "ids"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id``, and write the folder described above.

    Null and empty texts are the end id alone; null ids come first; rows that repeat an id are written one after the
    other, in the order of a hash of their texts. The ids are the library's, those of added tokens such as ``<|endoftext|>`` in a text included. Other columns are left out. ``tokenizer_path`` must be readable by the executors.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(_encode(tokenizer_path, end_id), "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>")
    made.write.options(**_FORMAT).parquet(f"{path}/ids")
    spark = docs.sparkSession
    sums = spark.read.parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    sums.select("part", "rows", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/parts")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) from the metadata columns alone."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    rows = spark.read.parquet(f"{path}/ids").select("part", "doc_id", "start_in_part", "n_tokens")
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); filters on doc_id reach the page indexes."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    rows = spark.read.parquet(f"{path}/ids")
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _crc(batches: Batches) -> Batches:
    for batch in batches:
        if batch.num_rows:
            rows = list_rows(batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; the checksum is of the ids as little-endian 32-bit numbers."""
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
