"""String and vector similarities.

What the JVM has no function for - common subsequences, Jaro-Winkler, best windows - runs on Python's long integers, one bit for each
character, so texts may have any length; Arrow batches carry the pairs, and one function gives all fuzzy features at once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .text import numeric_tokens, trigram_set

def levenshtein_norm(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def jaccard(x: Column, y: Column) -> Column:
    """Common over all elements; 0 if there are none."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def trigram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(trigram_set(a), trigram_set(b))


def numeric_token_overlap(a: Column, b: Column) -> Column:
    return jaccard(numeric_tokens(a), numeric_tokens(b))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.least(F.length(a), F.length(b)) / longest)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where one is zero."""

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


# On Python's long integers.


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _lcs(size: int, masks: dict[str, int], b: str) -> int:
    full = v = (1 << size) - 1
    for c in b:
        hit = masks.get(c)
        if hit:
            hit &= v
            v = ((v + hit) | (v - hit)) & full
    return size - v.bit_count()


def lcs_text(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(len(a), _masks(a), b)


def ratio_text(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    return 2 * lcs_text(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_text(a: str, b: str) -> float:
    """Best of the common tokens against each side's, and of both sides' own tokens; 0 if a side has none."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    common, own_a, own_b = ta & tb, ta - tb, tb - ta
    if common and (not own_a or not own_b):
        return 1.0
    x, y, s = " ".join(sorted(own_a)), " ".join(sorted(own_b)), len(" ".join(sorted(common)))
    gap = 1 if s else 0
    la, lb = s + gap + len(x), s + gap + len(y)
    apart = 1 - (len(x) + len(y) - 2 * lcs_text(x, y)) / (la + lb)
    return max(apart, 1 - (1 + len(x)) / (s + la), 1 - (1 + len(y)) / (s + lb)) if s else apart


def partial_text(a: str, b: str) -> float:
    """Best indel ratio of the shorter text with any window of the longer one, cut-off windows at its ends included."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    out = 0.0
    for short, long in ((a, b), (b, a)) if len(a) == len(b) else ((a, b) if len(a) < len(b) else (b, a),):
        n, m, masks = len(short), len(long), _masks(short)
        for i in range(1 - n, m):
            lo, hi = max(i, 0), min(i + n, m)
            # a cut-off window whose outer character the shorter text lacks is no better than the one without it
            if lo == 0 and hi < n and long[hi - 1] not in masks:
                continue
            if 2 * (hi - lo) / (n + hi - lo) > out:
                out = max(out, 2 * _lcs(n, masks, long[lo:hi]) / (n + hi - lo))
    return out


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity raised for a common start of up to four characters where it exceeds 0.7; 1 for two empty texts."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) == len(b) == 1:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hit = [True] * len(a), []
    for j, c in enumerate(b):
        for i in range(max(0, j - reach), min(len(a), j + reach + 1)):
            if free[i] and a[i] == c:
                free[i] = False
                hit.append(c)
                break
    m = len(hit)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip((c for c, f in zip(a, free, strict=True) if not f), hit, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _measure(plain: Callable[[str, str], float], kind: str = "double") -> Callable[[Column, Column], Column]:
    """A measure of two texts of any length as a function of Columns; null where a text is."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else plain(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    def column(a: Column, b: Column) -> Column:
        ship(SparkSession.active())
        return F.pandas_udf(of, kind)(a, b)

    column.__doc__ = plain.__doc__
    return column


def token_sort_text(a: str, b: str) -> float:
    """Ratio of both texts with their tokens in order."""
    return ratio_text(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


lcs, indel_ratio, token_sort_ratio, token_set_ratio = _measure(lcs_text, "int"), _measure(ratio_text), _measure(token_sort_text), _measure(token_set_text)
partial_ratio, jaro_winkler = _measure(partial_text), _measure(jaro_winkler_text)

FUZZY = ("jaro_winkler_raw", "jaro_winkler_norm", "token_sort_ratio", "token_set_ratio", "partial_ratio")


def _fuzzy(raw_a: pd.Series, raw_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [
        (jaro_winkler_text(p, q), jaro_winkler_text(x, y), token_sort_text(x, y), token_set_text(x, y), partial_text(x, y))
        for p, q, x, y in zip(raw_a, raw_b, a, b, strict=True)
    ]
    return pd.DataFrame(rows, columns=list(FUZZY))


def string_similarities(df: DataFrame, raw_a: str, raw_b: str, norm_a: str, norm_b: str) -> DataFrame:
    """``df`` with the nine string features of two texts and their normalised forms; null texts count as empty.

    The five fuzzy ones come from one Arrow function.
    """
    ship(df.sparkSession)
    ra, rb, a, b = (F.coalesce(F.col(c), F.lit("")) for c in (raw_a, raw_b, norm_a, norm_b))
    fuzzy = F.pandas_udf(_fuzzy, ", ".join(f"{n} double" for n in FUZZY))
    both = df.withColumn("_f", fuzzy(ra, rb, a, b)).select("*", "_f.*").drop("_f")
    return both.withColumns({"levenshtein_norm": levenshtein_norm(a, b), "trigram_jaccard": trigram_jaccard(a, b), "numeric_token_overlap": numeric_token_overlap(a, b), "length_ratio": length_ratio(a, b)})
