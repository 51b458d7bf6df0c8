"""Repeated runs of lines across a corpus by winnowing, DataFrame functions only.

Lines are the pieces between line breaks, without the blanks at their ends; lines without a word take no part and stay
where they are. A window is the shortest stretch of lines from a line onward (or from a line backward) that holds at
least ``min_words`` words, so any repeated run of that length holds whole windows, the same ones in both places. The
fingerprint of a window is its minimum in the order (fewer words last, then hash): a function of the content alone, so
both places choose the same line, and the longest line of a window is seldom a common phrase.

Only fingerprints are looked up in the corpus. Windows whose fingerprint occurs in one place only are done. The others
are matched by their content: forward windows extend a match to the right, backward windows to the left, and the union
of matched windows is the maximal run. The first place of a window (smallest id, then line) keeps it; its lines are
deleted everywhere else. Every step is a grouped minimum or count with partial sums on the map side and a join that
Spark can split, so a line held by a third of all documents makes no pairs and no large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.session import Workspace, durable

MIN_WORDS = 50
BLANK = r"[\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _document_key(doc_id: str, text: str) -> Column:
    """Rows of one id and one text are one document; a struct also joins null with null."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, pos, key, words): the lines with a word, their places and content keys (two 64-bit hashes)."""
    each = docs.select(_document_key(id_col, text_col).alias("d"), F.posexplode(_lines(F.col(text_col))).alias("pos", "raw"))
    line = F.regexp_replace("raw", f"^{BLANK}+|{BLANK}+$", "")
    rows = each.select("d", "pos", line.alias("line")).filter("line <> ''")
    # a blank run between words counts once, so the words are the runs plus one
    words = F.size(F.split("line", f"{BLANK}+", -1))
    return rows.select("d", "pos", F.struct(F.xxhash64("line").alias("x"), F.xxhash64("line", F.lit(1)).alias("y")).alias("key"), words.cast("long").alias("words"))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, lo, hi, mark, mark_pos, w): forward and backward windows, their fingerprint, its place, and content."""
    in_doc = Window.partitionBy("d").orderBy("pos")
    placed = lines.withColumn("end", F.sum("words").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("begin", F.col("end") - F.col("words"))
    rank = F.struct((-F.least("words", F.lit(min_words))).alias("few"), F.col("key").alias("key"), F.col("pos").alias("pos"))
    made = None
    for frame, backward in ((Window.partitionBy("d").orderBy("begin").rangeBetween(0, min_words - 1), False),
                            (Window.partitionBy("d").orderBy("end").rangeBetween(-(min_words - 1), 0), True)):
        found = placed.select(
            "d", F.min("pos").over(frame).alias("lo"), F.max("pos").over(frame).alias("hi"), F.sum("words").over(frame).alias("total"),
            F.min(rank).over(frame).alias("least"), F.collect_list("key").over(frame).alias("keys")).filter(F.col("total") >= min_words)
        found = found.select("d", "lo", "hi", F.col("least.key").alias("mark"), F.col("least.pos").alias("mark_pos"),
                             F.struct(F.lit(backward).alias("b"), F.xxhash64("keys").alias("x"), F.xxhash64("keys", F.lit(1)).alias("y")).alias("w"))
        made = found if made is None else made.union(found)
    return made


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, space: Workspace | None = None) -> DataFrame:
    """(d, deleted): the documents with later copies of runs, and the places of the lines to delete, ascending."""
    all_windows = windows(line_rows(docs, id_col, text_col).dropDuplicates(["d", "pos"]), min_words)
    if space is not None:
        all_windows = space.table(all_windows, "windows")
    # a fingerprint is repeated when its places are not all the same one
    place = F.struct("d", "mark_pos")
    marks = all_windows.groupBy("mark").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("mark")
    open_ = all_windows.join(marks, "mark")
    first = open_.groupBy("w").agg(F.min(F.struct("d", "lo")).alias("first"), F.max(F.struct("d", "lo")).alias("last")).filter("first <> last")
    later = open_.join(first.select("w", "first"), "w").filter(F.struct("d", "lo") != F.col("first"))
    spans = later.select("d", "lo", "hi").distinct()
    return spans.groupBy("d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("lo", "hi"))))).alias("deleted"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of runs deleted from the text, and ``deleted``, the places of the lines that went.

    A run is one or more consecutive lines of at least ``min_words`` words that occur, in the same order, at an
    earlier place (smaller id, or further up in the same document). Lines without words inside a deleted run go with
    it. Null and empty texts come back as they are, with no deletions; rows that repeat an id and text are one
    document and share the answer; rows that repeat an id with other texts are documents of their own. Null ids come
    first in the order. Other columns are kept; ``deleted`` replaces one of that name.
    """
    with Workspace(docs.sparkSession) as space:
        gone = durable(repeated_lines(docs, id_col, text_col, min_words, space))
    kept_names = [c for c in docs.columns if c != "deleted"]
    gone = gone.select(F.col("d").alias("_run_of"), F.col("deleted").alias("_run_lines"))
    joined = docs.select(*kept_names, _document_key(id_col, text_col).alias("_run_key")).join(gone, F.col("_run_key") == F.col("_run_of"), "left")
    lines = _lines(F.col(text_col))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_run_lines"))
    text = F.when(F.col("_run_lines").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(F.col("_run_split"), i + 1)), "\n"))
    split = joined.withColumn("_run_split", F.when(F.col("_run_lines").isNotNull(), lines))
    deleted = F.coalesce("_run_lines", F.array().cast("array<int>")).alias("deleted")
    return split.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept_names], deleted)
