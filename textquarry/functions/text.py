"""Text expressions shared by the operators. All stay in the JVM but NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = r"[\p{L}\p{N}]+"
TOKEN = r"(?U)\w+|[^\w\s]"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once, however often a lambda in the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normalisation form C; ASCII strings pass as they are."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def terms(text: Column) -> Column:
    """Lexical terms of a text in form C: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def content_terms(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct lower-cased words of more than one character, or digits, that aren't stopwords."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    kept = F.filter(words, lambda w: (F.length(w) > 1) | w.rlike(r"^\d$"))
    return F.array_except(kept, F.array(*[F.lit(x) for x in stopwords])) if stopwords else kept


def token_count(text: Column) -> Column:
    """Words and single other characters that aren't white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def ordered_distinct_folded(values: Column) -> Column:
    """Values in order, each once whatever its case."""
    start = F.expr("cast(array() as array<string>)")
    return F.aggregate(values, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, each joined by a space; the whole as one if it has fewer."""
    return let(words, lambda w: F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))


def _repeated(items: Column) -> Column:
    return let(items, lambda x: F.when(F.size(x) > 0, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(0.0)))


def ngram_repeat_ratio(text: Column, n: int) -> Column:
    """(n-grams - distinct n-grams) / n-grams over white-space tokens; 0 for texts of fewer tokens."""
    return _repeated(ngrams(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), n))


def duplicate_line_ratio(text: Column) -> Column:
    """(lines - distinct lines) / lines over trimmed non-blank lines; 0 without lines."""
    return _repeated(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
