import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions.text import normalize


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(prev[j - 1] + 1 if x == y else max(prev[j], row[-1]))
    return row[-1]


def some_pairs(n, seed):
    r = random.Random(seed)
    make = lambda: "".join(r.choice("abc d1é") for _ in range(r.randrange(0, 13))).strip()
    return [(make(), make()) for _ in range(n)] + [("", ""), ("", "a"), ("a", "a"), ("a", "b")]


def test_texts_against_plain_versions():
    for a, b in some_pairs(500, 1):
        assert S.lcs_text(a, b) == lcs_by_table(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            best = max(S.ratio_text(s, x[max(i, 0) : i + len(s)]) for s, x in ((short, long), *([(long, short)] if len(a) == len(b) else [])) for i in range(1 - len(s), len(x)))
            assert S.partial_text(a, b) == pytest.approx(best)


def jaro_winkler_plain(a, b):
    """By the definition, positions and flags only."""
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = set()
    pairs = []
    for j, c in enumerate(b):
        i = next((i for i in range(len(a)) if abs(i - j) <= reach and a[i] == c and i not in taken), None)
        if i is not None:
            taken.add(i)
            pairs.append((i, c))
    if not pairs:
        return 0.0
    m = len(pairs)
    moved = sum(a[i] != c for i, (_, c) in zip(sorted(taken), pairs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_columns_at_any_length(spark):
    r = random.Random(2)
    rows = some_pairs(60, 2)
    for _ in range(60):
        a = "".join(r.choice("abcdef ") for _ in range(r.randrange(0, 300)))
        b = "".join(c for c in a if r.random() > 0.2) if r.random() < 0.6 else "".join(r.choice("abcdef ") for _ in range(r.randrange(0, 300)))
        rows.append((a, b))
    cols = {"jw": S.jaro_winkler, "lcs": S.lcs, "ratio": S.indel_ratio}
    got = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "a string, b string").select("a", "b", *[c(F.col("a"), F.col("b")).alias(k) for k, c in cols.items()]).collect()
    assert [(x.jw, x.lcs, x.ratio) for x in got[-2:]] == [(None, None, None)] * 2
    for x in got[:-2]:
        common = lcs_by_table(x.a, x.b)
        assert (x.lcs, x.ratio) == (common, pytest.approx(2 * common / max(1, len(x.a) + len(x.b)) if x.a or x.b else 1.0))
        assert x.jw == pytest.approx(jaro_winkler_plain(x.a, x.b)), (x.a, x.b)


def features(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").withColumns({"x": normalize(F.col("a")), "y": normalize(F.col("b"))})
    return S.string_similarities(df, "a", "b", "x", "y").head()


def test_string_features(spark):
    same = features(spark, "adobe photoshop cs3", "adobe photoshop cs3")
    assert all(same[n] >= 0.9 for n in (*S.FUZZY, "levenshtein_norm", "trigram_jaccard", "numeric_token_overlap", "length_ratio"))
    assert features(spark, "microsoft word 2007", "angry birds game").jaro_winkler_norm < 0.5
    none = features(spark, None, "")
    assert (none.levenshtein_norm, none.trigram_jaccard, none.numeric_token_overlap, none.length_ratio) == (1.0, 0.0, 0.0, 0.0)
    assert (none.jaro_winkler_norm, none.token_sort_ratio, none.token_set_ratio, none.partial_ratio) == (1.0, 1.0, 0.0, 1.0)
    assert features(spark, "version 5.0 pro", "version 5.0 standard").numeric_token_overlap > 0
    assert features(spark, "x" * 300, "x" * 299 + "y").token_sort_ratio > 0.99


@pytest.mark.parametrize(("x", "y", "cos"), [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0)])
def test_cosine(spark, x, y, cos):
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    assert df.select(S.cosine(F.col("x"), F.col("y")).alias("c")).head().c == pytest.approx(cos)
