"""Layout shares of a text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\x20\x09-\x0D"

#: Steps by which the values of layout() become tokens.
STEPS = (0.5, 0.02, 0.02, 0.01, 0.02, 0.5, 0.5, 0.05, 0.02)


def n_words(split: Column) -> Column:
    """Number of words, 1 at least."""
    return F.greatest(F.size(F.array_remove(split, "")), F.lit(1))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: a filter that is pushed down would repeat it wherever it is used."""
    return F.transform(F.array(value), then)[0]


def layout(text: Column, split: Column, words: Column) -> list[Column]:
    """Shares of capitals, digits, marks and line ends, word and line lengths, and how often words repeat.

    text is not null; split is text split at white space, empty strings included; words is n_words(split).
    """
    size = F.octet_length(text)
    per_byte = F.greatest(size, F.lit(1))
    share = lambda which: (size - F.octet_length(F.regexp_replace(text, f"[{which}]+", ""))) / per_byte
    ends = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    doubled = F.regexp_count(text, F.lit(rf"(?<![^{_SPACE}])([^{_SPACE}]++)(?=[{_SPACE}]+\1(?![^{_SPACE}]))"))
    return [
        F.log1p(size),
        share("A-Z"),
        share("0-9"),
        share(r"#$%&*|!<>{}\\^~@_+="),
        ends / words,
        per_byte / words,
        F.log1p(words / (ends + 1)),
        F.size(F.array_remove(F.array_distinct(split), "")) / words,
        doubled / words,
    ]


def _tokens(text: Column, split: Column, words: Column) -> Column:
    values = zip(layout(text, split, words), STEPS, strict=True)
    return F.array(*[F.concat(F.lit(f"\x01{i}:"), (v / s).cast("long").cast("string")) for i, (v, s) in enumerate(values)])


def words_and_layout(text: Column) -> Column:
    """The words of a text that is not null, and one token per value of layout(): which value, and how many whole steps it has."""
    split = F.split(text, f"[{_SPACE}]+")
    return bound(split, lambda s: bound(n_words(s), lambda n: F.concat(s, _tokens(text, s, n))))
