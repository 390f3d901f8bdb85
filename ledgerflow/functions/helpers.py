"""The steps that column functions can't express, as small vectorized helpers."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import token_overlap


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of ``a`` to ``b``; it isn't symmetric, and 0 if either is empty."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_pair_score(a: Column, b: Column) -> Column:
    """Similarity of two normalised names: the greater of sequence ratio and token overlap; 0 if either is null or empty."""
    return F.greatest(sequence_ratio(a, b), token_overlap(a, b))


def group_lines(tops: list[float], bottoms: list[float], heights: list[float], near: float = 8.0, overlap: float = 0.4) -> list[int]:
    """The line of each word, words given by their top; a word joins the first line it overlaps or whose middle is near.

    A line's top and bottom are the means of its words', so they move as words join.
    """
    lines: list[list[float]] = []  # number of words, sum of tops, sum of bottoms
    out = []
    for top, bottom, height in zip(tops, bottoms, heights, strict=True):
        for k, (n, t, b) in enumerate(lines):
            t, b = t / n, b / n
            shared = max(0.0, min(bottom, b) - max(top, t))
            if shared > overlap * min(height, b - t) or abs((top + bottom) / 2 - (t + b) / 2) < near:
                break
        else:
            k = len(lines)
            lines.append([0, 0.0, 0.0])
        lines[k] = [lines[k][0] + 1, lines[k][1] + top, lines[k][2] + bottom]
        out.append(k)
    return out
