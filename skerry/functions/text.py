"""Tokenizers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of answer scoring.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did "
    "will would could should may might must shall can to of and in for "
    "on with at by from as into through during before after above below "
    "this that these those it its they their them we our us you your"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of [A-Za-z0-9_] of two characters or more, repeats kept; null is empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))


def terms(text: Column) -> Column:
    """The distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def content_tokens(text: Column) -> Column:
    """Tokens without stop words, repeats kept."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))
