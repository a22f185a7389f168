"""License scans: exact phrases, and short notices found with a bounded number of edits.

Texts are taken as words (A-Z lower-cased) joined by single spaces. A notice that
may hold k edits is split into k + 1 pieces; one of them must stand unedited in
any match, so an automaton over the pieces finds all candidate places, and the
regex library's bounded-error matching verifies each and counts the edits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.common import UPPER

# Phrases with labels, then short notices with labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
#: Word bytes: digits, small letters and all bytes of other characters; the rest separates.
_NORMAL = bytes(c + 32 if c in UPPER.encode() else c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else 32 for c in range(256))

_GRAM = 3


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


class Finder:
    """Phrases and notices made ready for search."""

    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], error_rate: float):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (label, text) in enumerate(notices):
            edits = int(len(text) * error_rate)
            grams = [text[i : i + _GRAM] for i in range(len(text) - _GRAM + 1)]
            # An edit spoils at most _GRAM grams, so a window with fewer of them holds no match.
            self.notices.append((label, text, edits, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}"), grams, len(grams) - _GRAM * edits))
            ends = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(ends, ends[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((at, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def base(self, joined: bytes) -> list[tuple[str, int]]:
        """(label, place) of each phrase, places in the joined words."""
        found = []
        padded = b" " + joined + b" "
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                found.append((label, at))
                at = padded.find(phrase, at + 1)
        return found

    def fuzzy(self, joined: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of each notice, leftmost first; spans of one notice don't overlap."""
        done = [0] * len(self.notices)
        tried = [-1] * len(self.notices)
        found = []
        for last, (size, places) in self.seeds.iter(joined):
            for at, offset in places:
                label, text, edits, pattern, grams, least = self.notices[at]
                start = last + 1 - size - offset
                begin, end = max(done[at], start - edits), start + len(text) + edits
                if last < done[at] or end <= begin:
                    continue
                exact = joined.find(text, begin, end)
                if exact >= 0:
                    found.append((label, exact, exact + len(text), 0, 1.0))
                    done[at] = exact + len(text)
                    continue
                if start == tried[at]:
                    continue
                tried[at] = start
                window = joined[begin:end]
                if sum(map(window.__contains__, grams)) < least:
                    continue
                match = pattern.search(window)
                if match and match.end() > match.start():
                    wrong = sum(match.fuzzy_counts)
                    found.append((label, begin + match.start(), begin + match.end(), wrong, 1 - wrong / len(text)))
                    done[at] = begin + match.end()
        return sorted(found, key=lambda f: f[1:3])


@functools.lru_cache(maxsize=4)
def finder(phrases: tuple, notices: tuple, error_rate: float) -> Finder:
    return Finder(phrases, notices, error_rate)


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    error_rate: float = 0.1,
) -> DataFrame:
    """Per input row: id, n_words, base (label, word), spans (label, start_word, end_word, edits, similarity).

    base holds every place of every phrase. spans holds the notices with at most
    error_rate edits per character, as word numbers from 0, end exclusive. Null,
    empty and word-less texts have none. Repeated rows are returned as often as
    they occur; extra columns are ignored. Whole texts are searched; no shuffle.
    """
    kinds = (tuple(phrases.items()), tuple(notices), error_rate)
    base = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
    span = [T.StructField("label", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("start_word", "end_word", "edits")), T.StructField("similarity", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("base", base), T.StructField("spans", T.ArrayType(T.StructType(span)))])

    def one(of: Finder, text: str | None) -> tuple[int, list[dict], list[dict]]:
        words = normal_words(text)
        joined = b" ".join(words)
        exact, near = of.base(joined), of.fuzzy(joined.decode("latin-1"))
        if not exact and not near:
            return len(words), [], []
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        word = lambda at: int(np.searchsorted(starts, at, "right")) - 1
        return (
            len(words),
            [{"label": label, "word": word(at)} for label, at in exact],
            [{"label": label, "start_word": word(a), "end_word": word(b - 1) + 1, "edits": e, "similarity": s} for label, a, b, e, s in near],
        )

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = finder(*kinds)
        for frame in frames:
            made = [one(of, t) for t in frame[text_col]]
            yield pd.DataFrame({id_col: frame[id_col], "n_words": [m[0] for m in made], "base": [m[1] for m in made], "spans": [m[2] for m in made]})

    return df.select(id_col, text_col).mapInPandas(batches, schema)
