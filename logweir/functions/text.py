"""Text columns: abbreviations, tokens, message cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.schema import ABBREVIATIONS, QUERY_TOKEN


def expand_abbreviations(text: Column) -> Column:
    """Whole words, any case. No expansion holds another key as a word, so folding is exact."""
    expanded = text
    for short, long in ABBREVIATIONS.items():
        expanded = F.regexp_replace(expanded, rf"(?i)\b{short}\b", long)
    any_short = rf"(?i)\b({'|'.join(ABBREVIATIONS)})\b"
    return F.when(text.rlike(any_short), expanded).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def query_tokens(text: Column) -> Column:
    """Identifiers and long words of a free-text query, left first."""
    return F.regexp_extract_all(text, F.lit(rf"(?i)({QUERY_TOKEN})"), 1)


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def replace_all(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Fold of ``(regex, token)`` replacements; an empty list passes the text through."""
    for pattern, token in replacements:
        text = F.regexp_replace(text, pattern, token)
    return text
