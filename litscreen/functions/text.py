"""Text as arrays of words: built-in functions only, so everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from litscreen.functions import fixed


def words(text: Column) -> Column:
    """Lower-case words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD_PATTERN), F.lit(0))


def without_stop_words(tokens: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def ranking_tokens(text: Column) -> Column:
    """The words that count for ranking."""
    return without_stop_words(words(text))


def search_words(text: Column) -> Column:
    """Lower-case words including one-character ones, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.SEARCH_WORD_PATTERN), F.lit(0))


def word_runs(tokens: Column, length: int) -> Column:
    """Every run of ``length`` neighbouring words, joined by a blank."""
    runs = tokens
    for n in range(2, length + 1):
        # Both sides are cut to the number of runs, so nothing is padded.
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), count), F.slice(tokens, F.lit(n), count), _joined)
    return runs


def _joined(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit(" "), right)


def section_texts(abstract: Column, sections: Column) -> Column:
    """Abstract paragraphs first, then the section texts; titles are left out."""
    return F.concat(abstract, F.transform(sections, lambda s: s["text"]))


def paragraph_words(abstract: Column, sections: Column) -> Column:
    """The search words of each paragraph; a null one has none."""
    return F.transform(section_texts(abstract, sections), lambda t: search_words(F.coalesce(t, F.lit(""))))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""
