"""Cleaning steps over whole tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.functions import scalars as S
from caselog.functions.hashing import hash_pick
from caselog.operators.ranks import lookup_skewed, rank_by_range


def clean_log(
    df: DataFrame,
    times: list[str] = (),
    flags: list[str] = (),
    numbers: list[str] = (),
    time_format: str | None = None,
) -> DataFrame:
    """All-text log to typed log: times to epoch seconds, flags to 0/1, numbers to double."""
    changes = {c: S.epoch_seconds(S.lenient_timestamp(c, time_format)) for c in times}
    changes.update({c: S.text_flag(c) for c in flags})
    changes.update({c: S.number_or_zero(c) for c in numbers})
    return df.withColumns(changes)


def zscore(df: DataFrame, columns: list[str], population: bool = False, guard: bool = True) -> DataFrame:
    """Centre and scale columns by statistics of the whole table (one row, broadcast).

    A constant column stays as it is (guard) or becomes 0 (no guard: 0/0 is later filled).
    """
    dev = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*[f(c).alias(f"_{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", dev))])
    wide = df.crossJoin(F.broadcast(stats))
    scaled = {}
    for c in columns:
        z = (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        flat = F.col(c).cast("double") if guard else F.lit(0.0)
        scaled[c] = F.when(F.col(f"_s_{c}") != 0, z).otherwise(flat)
    return wide.withColumns(scaled).drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def ratio_features(df: DataFrame, amount: str, monthly: str, score: str, terms: str) -> DataFrame:
    """Ratios and products of (scaled) loan figures; 0 where undefined."""
    cost = F.col(monthly) * F.col(terms)
    return df.withColumns({
        "credit_to_amount": S.ratio(score, amount),
        "credit_to_monthly": S.ratio(score, monthly),
        "risk_score": S.ratio(F.col(score) * F.col(terms), amount),
        "total_cost": cost,
        "cost_to_amount": S.ratio(cost, amount),
    })


def finite_table(df: DataFrame) -> DataFrame:
    """No null, NaN or infinity left: 0 for numbers, '' for text."""
    changes = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            changes[name] = S.finite_or_zero(name)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            changes[name] = F.coalesce(F.col(name), F.lit(0))
        elif kind == "string":
            changes[name] = S.or_empty(name)
    return df.withColumns(changes)


def ordinal_table(df: DataFrame, column: str) -> DataFrame:
    """0-based rank of each distinct value in sorted order.

    Ranked by sampled ranges, so a column with very many values is not sorted in one task.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = rank_by_range(values, [F.col(column)], "code")
    return ranked.withColumn("code", F.col("code") - 1)


def ordinal_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Attach the code of each value; null gives -1."""
    codes = ordinal_table(df, column).withColumnRenamed("code", out)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


# Sentence forms of the descriptive text column. The names in
# braces are columns of the log.
EVENT_SENTENCES = [
    "{event} for a {kind} application.",
    "Loan goal: {goal}. Processing event: {event}.",
    "An application for {goal} was {origin}.",
    "Requested amount of {amount} is under review.",
    "The event '{event}' occurred for a case related to {kind}.",
    "Details processed for loan amount: {amount}.",
    "{event} initiated for a {kind} with goal: {goal}.",
    "Action recorded during application review.",
    "Application event is being tracked for compliance.",
    "Loan application event: {origin}.",
]


def describe_events(df: DataFrame, key: str, columns: dict[str, str], out: str, seed: int = 42,
                    sentences: list[str] = EVENT_SENTENCES) -> DataFrame:
    """One sentence per event, its form picked by a hash of the row key."""
    forms = []
    for sentence in sentences:
        pieces, rest = [], sentence
        while "{" in rest:
            text, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            pieces += [F.lit(text), F.col(columns[name]).cast("string")]
        forms.append(F.concat(*pieces, F.lit(rest)))
    pick = hash_pick(key, seed, len(forms), digits=6).cast("int") + 1
    return df.withColumn(out, F.element_at(F.array(*forms), pick))


def lemmatise(df: DataFrame, key: str, tokens: str, lexicon: DataFrame, out: str) -> DataFrame:
    """Replace each token by its lemma from a (token, lemma) table and join by spaces; rows of one key are one text, token by token.

    A text's distinct tokens go out to be looked up and only those with a lemma come back to the tokens, which stay with their
    key. Frequent tokens would all meet in one join task, so the lookup splits them off by their count.
    """
    @F.arrow_udf("string")
    def replaced(rows: pa.Array, found: pa.Array) -> pa.Array:
        """The tokens of a key's rows by place, then by what they became."""
        lines = []
        for own, words in zip(rows, found):
            lemma = {w["token"]: w["lemma"] for w in words.as_py() or ()}
            lists = [[lemma.get(t, t) for t in row] for row in own.as_py()]
            if len(lists) > 1:
                lists = [[t for _, t in sorted(((p, t) for row in lists for p, t in enumerate(row) if t is not None), key=lambda x: (x[0], x[1].encode()))]]
            lines.append(" ".join(t for t in (lists[0] if lists else ()) if t is not None))
        return pa.array(lines, pa.string())

    long = df.select(key, F.explode_outer(F.array_distinct(tokens)).alias("token")).filter(F.col("token").isNotNull())
    weights = long.groupBy("token").agg(F.count(F.lit(1)).alias("_weight"))
    known = lexicon.select("token", "lemma").join(weights, "token")
    named = lookup_skewed(long, known, "token", "_weight", F.col(key)).filter(F.col("lemma").isNotNull())
    found = named.groupBy(key).agg(F.collect_set(F.struct("token", "lemma")).alias("_found"))
    texts = df.groupBy(key).agg(F.collect_list(tokens).alias("_rows")).join(found, key, "left")
    return df.join(texts.select(key, replaced("_rows", "_found").alias(out)), key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))
