"""Quality rules with verdicts per host, DataFrame functions only.

Every document is measured and put to a few rules. The failures of each rule are added up by host; a host's rate is
shrunk towards the rate of all hosts with a beta prior whose strength is estimated from the spread between hosts, so
a host of three documents says little and one of a million speaks for itself. The host's verdicts are joined back: a
document that fails a rule is dropped unless its host is trusted on that rule, and a host where most documents fail is
dropped whole. Hosts may be as uneven as they like: the sums are partial aggregates and the join carries numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.session import Workspace, durable

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
TRUSTED = 0.01
FAILING = 0.6


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words in 3-word windows found twice or more, from the ``w`` column, first ones included.

    A window's hash gives way in its low bits to its place, as many bits as places need; sorted, equal windows are
    neighbours, and neighbours of one hash are compared word by word. One sort per document, no pairs.
    """
    bits = F.ceil(F.log2(F.size("w").cast("double") + 1)).cast("int")
    low = F.expr("shiftleft(1L, _bits) - 1")
    packed = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseOR(F.col("_low")) - F.col("_low") + i)
    staged = df.withColumn("_bits", bits).withColumn("_low", low)
    staged = staged.withColumn("_packed", F.when(F.size("w") >= 3, packed).otherwise(F.array().cast("array<long>")))
    staged = staged.withColumn("_sorted", F.sort_array("_packed"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("_low")).cast("int")

    def same(x: Column, other: Column) -> Column:
        a, b = place(x), place(other)
        equal = (x.bitwiseOR(F.col("_low")) == other.bitwiseOR(F.col("_low")))
        return equal & (F.get("w", a) == F.get("w", b)) & (F.get("w", a + 1) == F.get("w", b + 1)) & (F.get("w", a + 2) == F.get("w", b + 2))

    found = F.filter(F.col("_sorted"), lambda x, i: F.coalesce(same(x, F.get("_sorted", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_sorted", i + 1)), F.lit(False)))
    staged = staged.withColumn("_again", found)
    covered = F.size(F.array_distinct(F.flatten(F.transform("_again", lambda x: F.sequence(place(x), place(x) + 2)))))
    return staged.withColumn("n_repeat_words", F.when(F.size("_again") == 0, 0).otherwise(covered).cast("long")).drop("_bits", "_low", "_packed", "_sorted", "_again")


def measures(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of each whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = docs.select(*keys, text.alias("_t"))
    split = split.withColumn("w", F.array_remove(F.split("_t", BLANKS, -1), "")).withColumn("_l", lines)
    counted = split.select(
        *keys, "w", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    return _repeat_words(counted).drop("w")


def rules() -> dict[str, Column]:
    """Failures of a measured document, by rule."""
    n = F.col("n_words")
    return {
        "symbols": F.col("n_symbols") * 5 > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "repeated_lines": F.col("n_dup_lines") * 10 > n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(measured: DataFrame, host: str, failures: list[str]) -> DataFrame:
    """Per host: documents and, for each rule, the shrunken rate of failure.

    The prior of a rule is Beta(m s, (1 - m) s): m the rate over all documents, s + 1 the ratio of m (1 - m) to what the
    rates of hosts vary beyond chance, between 1 and 10,000 (few hosts or no extra spread mean a strong prior).
    """
    by_host = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in failures])
    totals = []
    for f in failures:
        totals += [F.sum(f).alias(f"all_{f}"), F.sum(F.col(f).cast("double") * F.col(f) / F.col("n")).alias(f"square_{f}")]
    prior = by_host.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), *totals)
    strength = []
    for f in failures:
        m = F.col(f"all_{f}") / F.col("total")
        between = F.col(f"square_{f}") - m * F.col(f"all_{f}")  # sum of n (rate - m)^2
        spread = (between - (F.col("hosts") - 1) * m * (1 - m)) / F.greatest(F.col("total") - F.col("n2") / F.col("total"), F.lit(1.0))
        s = F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(10000.0))
        strength += [m.alias(f"m_{f}"), F.greatest(F.lit(1.0), F.least(F.lit(10000.0), s)).alias(f"s_{f}")]
    shrunk = by_host.crossJoin(F.broadcast(prior.select(*strength)))  # one row
    return shrunk.select("host", "n", *[((F.col(f) + F.col(f"m_{f}") * F.col(f"s_{f}")) / (F.col("n") + F.col(f"s_{f}"))).alias(f"rate_{f}") for f in failures])


def apply_host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", trusted: float = TRUSTED, failing: float = FAILING) -> DataFrame:
    """(id, host, measures, base_failed, failed, host_rate, kept), a row for each row of ``docs``.

    Null and empty texts have no words and fail the base rules; a null host is a host of its own; rows that repeat an id
    are judged row by row. A host's overall rate counts documents that fail the base or any rule. Other columns, whatever
    their names, are ignored.
    """
    with Workspace(docs.sparkSession) as space:
        # the costly part runs once: the rates and the verdicts both read what was measured
        measured = space.table(measures(docs.select(F.col(id_col).alias("_id"), F.col(host).alias("_host"), F.col(text_col).alias("_text")), ["_id", "_host"], "_text"), "measured")
        failures = rules()
        marked = measured.withColumn("base_failed", base_failed()).withColumns({f"fails_{f}": F.coalesce(c, F.lit(False)) for f, c in failures.items()})
        names = [f"fails_{f}" for f in failures]
        marked = marked.withColumn("fails_any", F.greatest("base_failed", *names))
        rates = host_rates(marked, "_host", [*names, "fails_any"]).withColumnRenamed("host", "_h").drop("n")
        # the join is on a struct, so that null meets null
        judged = marked.join(rates, F.struct(F.col("_host").alias("h")) == F.struct(F.col("_h").alias("h")))
        against = [F.col(f) & (F.col(f"rate_{f}") >= trusted) for f in names]
        verdict = F.greatest(*against, F.col("rate_fails_any") >= failing)
        failed = F.array_compact(F.array(*[F.when(F.col(f"fails_{f}"), F.lit(f)) for f in failures]))
        return durable(judged.select(
            F.col("_id").alias(id_col), F.col("_host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            failed.alias("failed_rules"), F.col("rate_fails_any").alias("host_rate"), (~F.col("base_failed") & ~verdict).alias("kept")))
