"""Words of a project name and the similarity of two names."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from worklens import vocab
from worklens.functions.text import col

_DROP = "^(?:" + "|".join((r"\d+[A-Z]?", "GIR", *vocab.POSTCODE_TOKENS, r"[A-Z]+\d+")) + ")$"


def meaningful_words(c: Column | str) -> Column:
    """Words that identify a project, in order, duplicates kept."""
    text = F.regexp_replace(col(c), r"(?U)\b(St|Dr|Rd)\.\s*", "$1 ")
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+(?:'\w+)*\b"), F.lit(0))

    def keep(word: Column) -> Column:
        upper = F.upper(word)
        return (
            ~upper.rlike(_DROP)
            & ~F.lower(word).isin(*vocab.STOP_WORDS)
            & ((F.length(word) > 2) | upper.isin(*vocab.SHORT_WORDS_KEPT))
        )

    return F.filter(tokens, keep)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-cased texts; NULL when one is missing."""
    out = []
    matcher = SequenceMatcher()
    for a, b in zip(left, right):
        if a is None or b is None:
            out.append(None)
            continue
        matcher.set_seqs(a.lower(), b.lower())
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


@lru_cache(1 << 16)
def _ratio(left: str, right: str) -> float:
    """Ratio of two lower-cased texts; titles recur over the rows of many tasks."""
    return SequenceMatcher(None, left, right).ratio()


def _best_of_two(name: str | None, reference: str | None, title: str | None) -> float:
    if name is None:
        return 0.0
    name = name.lower()
    best = _ratio(name, title.lower()) if title else 0.0
    if reference is not None:
        reference = reference.lower()
        length = len(name) + len(reference)
        # Lengths alone rule out most references; the matcher is built for the others only.
        if (2.0 * min(len(name), len(reference)) / length if length else 1.0) > best:
            matcher = SequenceMatcher(None, name, reference)
            if matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
    return best


@F.pandas_udf(T.DoubleType())
def _best_ratio(name: pd.Series, reference: pd.Series, title: pd.Series) -> pd.Series:
    """Best of the two ratios; the reference is skipped when its upper bound cannot win."""
    return pd.Series([_best_of_two(n, r, t) for n, r, t in zip(name, reference, title)], dtype="float64")


# A filter on the ratio would otherwise move it in front of a repartition, and work it out again behind.
_best_ratio = _best_ratio.asNondeterministic()


def name_similarity(name: Column | str, reference: Column | str, title: Column | str) -> Column:
    """Best ratio against the reference and the title; a missing title counts as 0."""
    return _best_ratio(col(name), col(reference), col(title))
