"""Term weights, term scores and term selection over (document, term) rows.

The vocabulary is a table and never visits the driver; only the few
selected terms are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.functions import text as T
from caselog.operators.ranks import lookup_skewed, rank_by_range


def each_token(docs: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """One row per token. The outer form keeps the optimizer from testing the
    tokens for emptiness at the scan, which would split every text again."""
    return docs.select(*keep, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())


def term_counts(docs: DataFrame, key: str, tokens: Column, keep: list[str] = (), ngram: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, term, tf); ``keep`` columns are constant per document."""
    cut = docs.select(key, *keep, tokens.alias("_tokens"))
    long = each_token(cut, [key, *keep], T.ngrams("_tokens", *ngram))
    return long.groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(cells: DataFrame) -> DataFrame:
    return cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def sorted_vocabulary(cells: DataFrame, more_than: int = 0) -> DataFrame:
    """(term, df, idx) with idx 0.. in term order, ranked by sampled ranges; of the terms that occur more than ``more_than`` times."""
    terms = document_frequencies(cells)
    if more_than > 0:
        terms = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_n")).filter(F.col("_n") > more_than).drop("_n")
    ranked = rank_by_range(terms, [F.col("term")], "idx")
    return ranked.withColumn("idx", F.col("idx") - 1)


def l2_normalised(weighted: DataFrame, key: str) -> DataFrame:
    """Scale the weights of each document to length 1."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weighted.withColumn("weight", F.when(norm > 0, F.col("weight") / F.nullif(norm, F.lit(0.0))).otherwise(F.col("weight")))


def tfidf(cells: DataFrame, key: str, frequencies: DataFrame, n_docs: DataFrame | int, form: str = "smooth") -> DataFrame:
    """(…, term, tf, weight) with documents scaled to length 1.

    smooth: tf * (ln((1+n)/(1+df)) + 1). log2: tf * log2(n/df), as topic models use.
    ``n_docs`` is a number or a one-row table with column n_docs. Frequent
    terms are looked up by broadcast, the rest by a shuffled join.
    """
    looked = lookup_skewed(cells, frequencies.select("term", "df"), "term", "df", F.col(key)).filter(F.col("df").isNotNull())
    if isinstance(n_docs, DataFrame):
        looked = looked.crossJoin(F.broadcast(n_docs))  # one row
        n = F.col("n_docs")
    else:
        n = F.lit(n_docs)
    if form == "smooth":
        idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    elif form == "log2":
        idf = F.log2(n.cast("double") / F.col("df"))
    else:
        raise ValueError("form is smooth or log2")
    weighted = looked.withColumn("weight", F.col("tf") * idf).drop("df", "n_docs")
    return l2_normalised(weighted, key)


def frequent_tokens(docs: DataFrame, tokens: Column, min_freq: int) -> DataFrame:
    """Tokens that occur more than min_freq times in the corpus."""
    counts = each_token(docs, [], tokens).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > min_freq)


def keep_terms(cells: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows whose term is in the kept table (term, n); n is its number of occurrences."""
    found = lookup_skewed(cells, kept.select("term", "n"), "term", "n", F.col(key))
    return found.filter(F.col("n").isNotNull()).drop("n")


def class_shares(docs: DataFrame, label: str) -> DataFrame:
    """One row: array of (label, share) over the classes, and the document count."""
    counts = docs.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    packed = counts.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("y"), F.col("_n").alias("n")))).alias("c"),
                        total.alias("n_docs"))
    return packed.select("n_docs", F.transform("c", lambda x: F.struct(
        x["y"].alias("y"), (x["n"] / F.col("n_docs")).alias("share"))).alias("_classes"))


def chi_square(cells: DataFrame, label: str, weight: str, shares: DataFrame) -> DataFrame:
    """(term, chi2): weight sums per class against class share x total.

    Two levels: (term, class) sums with map-side partials, then one row per
    term holding its few class sums. Absent cells count as observed 0.
    """
    per_class = cells.groupBy("term", label).agg(F.sum(weight).cast("double").alias("_o"))
    per_term = per_class.groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct(label, "_o"))).alias("_m"), F.sum("_o").alias("_t"))

    def add(acc, c):
        expected = c["share"] * F.col("_t")
        gap = F.coalesce(F.element_at("_m", c["y"]), F.lit(0.0)) - expected
        return acc + F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0))

    scored = per_term.crossJoin(F.broadcast(shares))  # one row
    return scored.select("term", F.aggregate("_classes", F.lit(0.0), add).alias("chi2"))


def top_terms(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best terms; equal scores in term order."""
    return scores.orderBy(F.desc(score), "term").limit(k)


def log_count_ratio(cells: DataFrame, label: str, positive, alpha: float, docs: DataFrame) -> DataFrame:
    """(term, r): log of the term's share among positives over its share among the rest.

    A class without documents contributes the constant 1.
    """
    is_pos = F.col(label) == F.lit(positive)
    terms = cells.groupBy("term").agg(
        (F.sum(F.when(is_pos, F.col("tf")).otherwise(0)) + F.lit(alpha)).cast("double").alias("p"),
        (F.sum(F.when(is_pos, 0).otherwise(F.col("tf"))) + F.lit(alpha)).cast("double").alias("q"))
    totals = terms.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    sizes = docs.agg(F.count_if(is_pos).alias("_np"), F.count_if(~is_pos).alias("_nn"))
    wide = terms.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(sizes))  # one row each
    p = F.when(F.col("_np") > 0, F.col("p") / F.col("_p")).otherwise(1.0)
    q = F.when(F.col("_nn") > 0, F.col("q") / F.col("_q")).otherwise(1.0)
    return wide.select("term", F.log(p / q).alias("r"))


def both_ends(ratios: DataFrame, k: int) -> DataFrame:
    """The k//2 lowest and the k//2 highest ratios; ties in term order."""
    half = k // 2
    if half < 1:
        raise ValueError("need k of at least 2 to take terms from both ends")
    low = ratios.orderBy("r", "term").limit(half)
    high = ratios.orderBy(F.desc("r"), F.desc("term")).limit(half)
    return low.unionByName(high).distinct()


def stack_texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per (key, text column): event position from 1 and its text."""
    return df.select(key, F.posexplode(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])).alias("_p", "text")).select(
        key, (F.col("_p") + 1).alias("event"), "text")


def side_by_side(blocks: DataFrame, key: str, vector: str, size: int, events: int, prefix: str) -> DataFrame:
    """``{prefix}{i}_event{e}`` columns from one value array per (key, event)."""
    aggs = [F.max(F.when(F.col("event") == e, F.col(vector)[i])).alias(f"{prefix}{i + 1}_event{e}")
            for e in range(1, events + 1) for i in range(size)]
    return blocks.groupBy(key).agg(*aggs)


def term_columns(cells: DataFrame, key: str, value: str, terms: list[str], docs: DataFrame) -> DataFrame:
    """One column per selected term, 0 where a document lacks it."""
    aggs = [F.coalesce(F.max(F.when(F.col("term") == t, F.col(value))), F.lit(0.0)).alias(t) for t in terms]
    wide = cells.filter(F.col("term").isin(terms)).groupBy(key).agg(*aggs)
    return docs.select(key).join(wide, key, "left").na.fill(0.0)


class NGramSelector:
    """Bag of n-grams: the terms with the best chi-square scores."""

    def __init__(self, key: str, text: str, label: str, ngram_min: int = 1, ngram_max: int = 1, tfidf: bool = False,
                 nr_selected: int | str = 100):
        self.key, self.text, self.label = key, text, label
        self.ngram_min, self.ngram_max, self.use_tfidf, self.nr_selected = ngram_min, ngram_max, tfidf, nr_selected
        self.selected: DataFrame | None = None

    def _cells(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        tokens = T.words(F.coalesce(F.col(self.text), F.lit("")))
        return term_counts(docs, self.key, tokens, keep, (self.ngram_min, self.ngram_max))

    def _weights(self, cells: DataFrame) -> DataFrame:
        if self.use_tfidf:
            return tfidf(cells, self.key, self.frequencies, self.n_docs)
        return cells.withColumn("weight", F.col("tf").cast("double"))

    def fit(self, docs: DataFrame) -> "NGramSelector":
        self.frequencies = document_frequencies(self._cells(docs, []))
        self.n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
        weights = self._weights(self._cells(docs, [self.label]))
        self.scores = chi_square(weights, self.label, "weight", class_shares(docs, self.label))
        self.selected = self.scores if self.nr_selected == "all" else top_terms(self.scores, "chi2", int(self.nr_selected))
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        """(key, term, weight) of the selected terms."""
        if self.selected is None:
            raise ValueError("fit before transform")
        weights = self._weights(self._cells(docs, [])).select(self.key, "term", "weight")
        chosen = self.selected.select("term")
        if self.nr_selected != "all":
            chosen = F.broadcast(chosen)  # at most nr_selected rows
        return weights.join(chosen, "term", "left_semi")


class LogRatioSelector:
    """Term counts times the Naive Bayes log count ratio, terms taken from both ends."""

    def __init__(self, key: str, text: str, label: str, ngram_min: int = 1, ngram_max: int = 1, alpha: float = 1.0,
                 nr_selected: int | str = 100, pos_label="positive"):
        self.key, self.text, self.label, self.alpha, self.pos_label = key, text, label, alpha, pos_label
        self.ngram_min, self.ngram_max, self.nr_selected = ngram_min, ngram_max, nr_selected
        self.selected: DataFrame | None = None

    _cells = NGramSelector._cells

    def fit(self, docs: DataFrame) -> "LogRatioSelector":
        cells = self._cells(docs, [self.label])
        self.ratios = log_count_ratio(cells, self.label, self.pos_label, self.alpha, docs)
        # both_ends on a vocabulary of at most k terms returns every term once
        if self.nr_selected == "all" or self.ratios.limit(int(self.nr_selected) + 1).count() <= int(self.nr_selected):
            self.selected = self.ratios
        else:
            self.selected = both_ends(self.ratios, int(self.nr_selected))
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        if self.selected is None:
            raise ValueError("fit before transform")
        chosen = self.selected if self.nr_selected == "all" else F.broadcast(self.selected)  # at most nr_selected rows
        joined = self._cells(docs, []).join(chosen, "term")
        return joined.select(self.key, "term", (F.col("tf") * F.col("r")).alias("weight"))
