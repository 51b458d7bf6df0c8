"""Tokens, n-grams and text templates as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselog.functions.scalars import col

# Fixed value: a word is two or more letters (of any script), numbers or underscores in a row.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def words(c) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_PATTERN), F.lit(0))


def split_tokens(c, lower: bool = True) -> Column:
    """Pieces between white space of any script."""
    text = F.lower(col(c)) if lower else col(c)
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def ngrams(tokens, low: int = 1, high: int = 1) -> Column:
    """All runs of low..high tokens joined by a space.

    Runs of n tokens extend the runs of n-1 by one zip, so the work is linear
    in the text. Pass a stored column, since it is read several times.
    """
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    t = col(tokens)
    runs, parts = t, [t] if low == 1 else []
    for n in range(2, high + 1):
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), count), F.slice(t, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            parts.append(runs)
    return parts[0] if len(parts) == 1 else F.concat(*parts)
