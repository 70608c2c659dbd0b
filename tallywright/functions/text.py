"""Text normalisation as column expressions.

Python's ``\\w``, ``\\s`` and ``\\d`` are Unicode-aware; the classes below spell the
same sets out so that Java regex (and RE2) agree on accented text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\p{Z}\s\x{b}\x{1c}-\x{1f}\x{85}"

EDGE_SPACE = f"^[{SPACE}]+|[{SPACE}]+$"
URL = f"http[^{SPACE}]+"
DIGITS = r"\p{Nd}+"
PUNCTUATION = f"[^{WORD}{SPACE}]"
TOKEN = f"[{WORD}]{{2,}}"
LETTERS_ONLY = r"^\p{L}+$"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: str | Column) -> Column:
    """Remove all surrounding whitespace, not only spaces."""
    return F.regexp_replace(_column(text), EDGE_SPACE, "")


def preprocess_text(text: str | Column) -> Column:
    """Drop links, digits and punctuation, trim and lower-case; null becomes ''."""
    column = F.coalesce(_column(text), F.lit(""))
    # Most texts have no link, and a substring search is much cheaper than the pattern.
    column = F.when(column.contains("http"), F.regexp_replace(column, URL, "")).otherwise(column)
    column = F.regexp_replace(column, DIGITS, "")
    return F.regexp_replace(F.lower(strip(column)), PUNCTUATION, "")


def token_filter(text: str | Column, stop_words: Sequence[str] = (), min_length: int = 3) -> Column:
    """Keep purely alphabetic words of at least ``min_length`` letters that are not stop words."""
    words = F.split(_column(text), f"[{SPACE}]+")
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    kept = F.filter(
        words,
        lambda w: w.rlike(LETTERS_ONLY) & (F.length(w) >= min_length) & ~F.array_contains(stop, w),
    )
    return F.array_join(kept, " ")


def flatten_text(text: str | Column) -> Column:
    """One-line form for delimited output: line breaks to spaces, pipes to slashes, single spaces."""
    column = F.translate(_column(text), "\n\r|", "  /")
    return strip(F.regexp_replace(column, " +", " "))


def render_prompt(template: str | Column, text: str | Column, placeholder: str = "{demanda}") -> Column:
    """Put the text in the template's placeholder."""
    return F.replace(_column(template), F.lit(placeholder), _column(text))


def training_line(label: str | Column, text: str | Column) -> Column:
    """``__label__<label> <text>`` on one line, as supervised text trainers read it."""
    one_line = F.translate(_column(text), "\n", " ")
    return F.concat(F.lit("__label__"), underscore_label(label), F.lit(" "), one_line)


def underscore_label(label: str | Column) -> Column:
    return F.translate(_column(label), " ", "_")


def spaced_label(label: str | Column) -> Column:
    """Undo ``underscore_label`` and remove the line prefix."""
    return F.translate(F.regexp_replace(_column(label), "__label__", ""), "_", " ")


def word_tokens(text: str | Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(TOKEN), F.lit(0))


def counted(terms: Column) -> Column:
    """The distinct ``terms`` of an array with their numbers, as an array of structs ``term, tf``.

    Counting happens inside the row, over the sorted array.
    """

    def runs(ordered: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, F.greatest(i - 1, F.lit(0)))),
        )
        ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(ordered)))
        return F.zip_with(
            heads, ends, lambda a, b: F.struct(F.get(ordered, a).alias("term"), (b - a).cast("long").alias("tf"))
        )

    # As a lambda variable the array is sorted once, not once per use.
    found = F.get(F.transform(F.array(F.sort_array(terms)), runs), 0)
    return F.when(F.size(terms) > 0, found)


def bigrams(tokens: Column) -> Column:
    shifted = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(starts, shifted, lambda a, b: F.concat_ws(" ", a, b))


def ngram_tokens(text: str | Column, max_n: int = 1, stop_words: Sequence[str] = ()) -> Column:
    """Words, followed by adjacent word pairs when ``max_n`` is 2."""
    tokens = word_tokens(text)
    if stop_words:
        stop = F.array(*[F.lit(w) for w in stop_words])
        tokens = F.filter(tokens, lambda w: ~F.array_contains(stop, w))
    if max_n == 1:
        return tokens
    if max_n == 2:
        # As a lambda variable the words are extracted once, not once per use.
        return F.get(F.transform(F.array(tokens), lambda words: F.concat(words, bigrams(words))), 0)
    raise ValueError("max_n must be 1 or 2")
