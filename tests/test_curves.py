import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import curves as C
from matchloom.operators import profile as P


def scored(spark, ys, ss):
    return spark.createDataFrame([(float(y), float(s)) for y, s in zip(ys, ss, strict=True)], "y double, s double")


def test_perfect_and_wrong(spark):
    good = C.metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.9, 0.8]), 0.5).head()
    assert (good.precision, good.recall, good.f1, good.auc_roc, good.average_precision) == (1, 1, 1, 1, 1)
    bad = C.metrics(scored(spark, [0, 0, 1, 1], [0.9, 0.8, 0.1, 0.2]), 0.5).head()
    assert (bad.precision, bad.recall, bad.f1) == (0, 0, 0)
    assert len(good.asDict()) == 10
    assert C.metrics(scored(spark, [1, 1], [0.9, 0.8]), 0.5).head().auc_roc is None


def test_against_brute_force(spark):
    r = random.Random(3)
    ys = [r.random() < 0.4 for _ in range(200)]
    ss = [round(min(1, max(0, r.gauss(0.6 if y else 0.4, 0.2))), 1) for y in ys]
    df = scored(spark, ys, ss)
    pos, neg = [s for y, s in zip(ys, ss, strict=True) if y], [s for y, s in zip(ys, ss, strict=True) if not y]
    assert C.roc_auc(df).head().auc_roc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    cuts = sorted(set(ss), reverse=True)
    point = {t: (sum(p >= t for p in pos) / sum(s >= t for s in ss), sum(p >= t for p in pos) / len(pos)) for t in cuts}
    steps = [0.0, *[point[t][1] for t in cuts]]
    assert C.average_precision(df).head().average_precision == pytest.approx(sum((steps[i + 1] - steps[i]) * point[t][0] for i, t in enumerate(cuts)))
    f1 = {t: 2 * p * q / (p + q) if p + q else 0 for t, (p, q) in point.items()}
    best = C.max_f1(df).head()
    assert best.f1 == pytest.approx(max(f1.values())) and best.threshold == min(t for t, f in f1.items() if f == pytest.approx(max(f1.values())))
    assert C.pr_curve(df).count() == len(cuts) + 1
    assert sum(x.n for x in C.reliability(df).collect()) == 200


def test_isotonic_pools(spark):
    fit = {r.s: r.fitted for r in C.isotonic(scored(spark, [0, 1, 0, 1], [0.1, 0.2, 0.3, 0.4])).collect()}
    assert fit == pytest.approx({0.1: 0.0, 0.2: 0.5, 0.3: 0.5, 0.4: 1.0})


def test_class_weight(spark):
    assert C.class_weight(scored(spark, [0, 0, 0, 1], [0] * 4)).head().weight == 3.0
    assert C.class_weight(scored(spark, [0, 0], [0] * 2)).head().weight is None


def test_profiles(spark):
    df = spark.createDataFrame([(1, 2.0, "ab"), (2, None, None), (3, 600.0, "abcd"), (4, float("nan"), "abc")], "id long, p double, t string")
    assert {r.column: r.nulls for r in P.null_profile(df, ["p", "t"]).collect()} == {"p": 1, "t": 1}
    d = P.describe(df, "p").head()
    assert (d["count"], d["min"], d["q50"], d["max"]) == (2, 2.0, 301.0, 600.0)
    assert {(r.bin, r.n) for r in P.histogram(df, "p", 5, clip=500.0).collect()} == {(0, 1), (4, 1)}
    assert P.median_length(df, "t").head().median_length == 3.0
    assert [r.id for r in P.top_k(df.where(~F.isnan("p")), F.col("p"), 1, "id").collect()] == [3]
    assert P.describe(df.limit(0), "p").head()["count"] == 0
    decided = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 0, 1)], "k long, y int, pred int")
    assert {(r.kind, r.k) for r in P.error_samples(decided, "k", 1).collect()} == {("fp", 1), ("fn", 2)}
    mix = P.label_mix({"x": spark.createDataFrame([(1,), (0,), (None,)], "label int")}).head()
    assert (mix.positives, mix.total) == (1, 3)


def test_running_sums_and_quantiles(spark):
    import numpy as np

    from matchloom.operators.curves import running_sums
    from matchloom.operators.profile import describe, first_per_class, median_length, quantiles

    r = random.Random(8)
    values = [r.choice([r.random(), round(r.random(), 1)]) for _ in range(700)]
    df = spark.createDataFrame([(v, "x" * i) for i, v in enumerate(values)] + [(None, None), (float("nan"), "")], "v double, t string").repartition(3)
    counted = df.where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((x.v, x.n, x.upto, x.all_n) for x in running_sums(counted, "v", {"n": "upto"}).collect())
    assert [x[2] for x in rows] == np.cumsum([x[1] for x in rows]).tolist() and {x[3] for x in rows} == {700}
    q = quantiles(df, F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.999}).head()
    assert list(q) == pytest.approx(np.quantile(values, [0.1, 0.5, 0.999]).tolist())
    d = describe(df, "v").head()
    assert (d["count"], d.q75) == (700, pytest.approx(np.quantile(values, 0.75)))
    assert median_length(df, "t").head().median_length == pytest.approx(np.median([*range(700), 0]))
    assert describe(df.limit(0), "v").head().q50 is None
    assert sorted(x.v for x in first_per_class(df.where("v < 0.5").withColumn("k", F.lit(1)), "k", 2, "v").collect()) == sorted(values)[:2]
