"""Exact copies by two passes of Bloom filtering, in DataFrame functions only.

First pass: the hash of every text sets one bit of a Bloom filter of 2^40 bits, kept as 64-bit words of which only the touched
ones exist. Words are merged by OR on the map side and on the reduce side, next to the number of hashes that met in them. A word
with more hashes than bits set holds a repeat: equal hashes set the same bit, so no repeat is missed, and no text, id or whole
hash is shuffled. The words found so make a second, blocked filter (all bits of a word in one block of 4 KB) of at most
``most_bytes``, which is broadcast.

Second pass: rows that the second filter doesn't know go straight through as the only one of their kind. Only the others shuffle:
they are grouped by SHA-256, and groups take their largest id. A filter at its bound lets more single rows through to the grouping
and loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.skew import join_groups
from caselog.session import durable

MOST_BYTES = 64 << 20
BLOCK_BITS = 32_768  # fixed value: the bits of one bitmap of Spark's bitmap functions
BITS_A_WORD = 16

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def free_prefix(columns: list[str], stem: str) -> str:
    """A prefix that no column has."""
    while any(c.lower().startswith(stem) for c in columns):
        stem += "_"
    return stem


def _bloom_word(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 30)


def _places(word: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a word and its three bits there."""
    bits = F.xxhash64(word, F.lit(1))
    return F.pmod(F.xxhash64(word), F.lit(blocks)), F.array(*[F.shiftrightunsigned(bits, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(3)])


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1


def repeated_words(hashes: DataFrame) -> DataFrame:
    """(word): words of the first filter in which some hash of the one column ``h`` is met twice."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    met = hashes.select(_bloom_word(F.col("h")).alias("word"), bit.alias("bit"))
    return met.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n")).filter("n > bit_count(bits)").select("word")


def repeat_filter(words: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, int]:
    """(block, bitmap) over the given words, and the number of blocks: ``BITS_A_WORD`` bits a word, ``most_bytes`` at most."""
    blocks = max(1, min(most_bytes * 8, words.count() * BITS_A_WORD) // BLOCK_BITS)
    block, bits = _places(F.col("word"), blocks)
    placed = words.select(block.alias("block"), bits.alias("bits")).repartition("block")
    return placed.select("block", F.explode("bits").alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), blocks


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; null counts as the empty text. ``keep_id`` is the largest id among equal texts (null ids count
    as smallest, and it is null if all are), ``kept`` is true for exactly one row of each group: the one with that id. Rows that
    repeat an id and a text are told apart by their place in the table, so ``docs`` must come in the same order when read again, as
    a stored table does; without such rows any table will do. Columns of ``docs`` named like the four are replaced, other names are
    free. An empty table gives an empty table. Copies are counted before they are shuffled, groups above 1/1024 of the repeated
    rows (so at most 1024 of them) are broadcast, and the join with the other groups is even.
    """
    p = free_prefix(docs.columns, "_x")
    kept_columns = [c for c in docs.columns if c not in ADDED]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    sha = F.sha2(text, 256)
    rows = docs.withColumns({f"{p}word": _bloom_word(F.xxhash64(text)), f"{p}id": F.col(f"`{id_col}`")})

    words = durable(repeated_words(docs.select(F.xxhash64(text).alias("h"))))
    bitmaps, blocks = repeat_filter(words, most_bytes)
    bitmaps = durable(bitmaps)
    block, bits = _places(F.col(f"{p}word"), blocks)
    probe = bitmaps.select(F.col("block").alias(f"{p}block_"), F.col("bitmap").alias(f"{p}bitmap"))
    probed = rows.withColumns({f"{p}uid": F.monotonically_increasing_id(), f"{p}block": block, f"{p}bits": bits}).join(
        F.broadcast(probe), F.col(f"{p}block") == F.col(f"{p}block_"), "left")  # most_bytes at most
    hit = [_is_set(F.col(f"{p}bitmap"), F.col(f"{p}bits")[i]) for i in range(3)]
    probed = probed.withColumn(f"{p}maybe", F.coalesce(hit[0] & hit[1] & hit[2], F.lit(False)))
    maybe = probed.filter(F.col(f"{p}maybe")).withColumn(f"{p}sha", sha)

    each = maybe.groupBy(f"{p}sha", f"{p}id").agg(F.count(F.lit(1)).alias("n"), F.max(f"{p}uid").alias("uid"))
    groups = each.groupBy(F.col(f"{p}sha").alias("sha")).agg(F.max(F.struct(F.col(f"{p}id").alias("id"), "n", "uid")).alias("top"), F.sum("n").alias("size"))
    groups = durable(groups.filter("size > 1"))
    found = join_groups(maybe, groups.withColumnRenamed("sha", f"{p}sha"), f"{p}sha", "size", F.col(f"{p}uid"), f"{p}g_")
    top, size = F.col(f"{p}g_top"), F.col(f"{p}g_size")
    own = F.when(top["n"] == 1, F.col(f"{p}id").eqNullSafe(top["id"])).otherwise(F.col(f"{p}uid") == top["uid"])
    shared = found.select(
        *[F.col(f"`{c}`") for c in kept_columns], F.when(size.isNull(), F.col(f"{p}id")).otherwise(top["id"]).alias("keep_id"),
        F.coalesce(size, F.lit(1).cast("long")).alias("group_size"), F.coalesce(own, F.lit(True)).alias("kept"), F.col(f"{p}sha").alias("text_sha256"))
    single = probed.filter(~F.col(f"{p}maybe")).select(
        *[F.col(f"`{c}`") for c in kept_columns], F.col(f"{p}id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha.alias("text_sha256"))
    return single.unionByName(shared)
