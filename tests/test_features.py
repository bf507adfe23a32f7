import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import features as X

ENTITY = "id long, title string, manufacturer string, price double"


def row(spark, a, b):
    t = [spark.createDataFrame([(1, *r)], ENTITY) for r in (a, b)]
    pairs = spark.createDataFrame([(1, 1, 1)], "ltable_id long, rtable_id long, label int")
    return X.pair_features(pairs, *t, X.precompute_embeddings(t[0]), X.precompute_embeddings(t[1])).head()


def test_all_features_in_order(spark):
    r = row(spark, ("adobe photoshop", "Adobe Inc", 100.0), ("adobe photoshop", "adobe", 50.0))
    assert r.asDict().keys() == {"ltable_id", "rtable_id", "label", *X.FEATURE_NAMES} and len(X.FEATURE_NAMES) == 20
    assert (r.price_abs_diff, r.price_rel_diff, r.manufacturer_exact, r.has_price_both, r.has_manufacturer_both) == (50.0, 0.5, 1.0, 1.0, 1.0)
    assert r.price_log_ratio == pytest.approx(math.log(2)) and r.emb_name_cosine == pytest.approx(1.0)
    assert (r.high_name_sim_price_mismatch, r.disagreeing_fields) == (0.0, 1.0)


def test_missing_values(spark):
    r = row(spark, ("a b c", None, None), ("a b c", "nan", 5.0))
    assert (r.has_price_both, r.has_manufacturer_both) == (0.0, 0.0)
    assert [r[c] for c in ("price_abs_diff", "price_log_ratio", "price_rel_diff", "manufacturer_exact", "manufacturer_jw")] == [None] * 5
    assert (r.high_name_sim_price_mismatch, r.disagreeing_fields) == (0.0, 0.0)
    assert row(spark, (None, None, None), ("nan", None, None)).jaro_winkler_raw == 1.0


@pytest.mark.parametrize(("rel", "exact", "want"), [(0.6, None, (1.0, 1.0)), (0.05, None, (0.0, 0.0)), (0.9, 0.0, (1.0, 2.0)), (None, 1.0, (0.0, 0.0))])
def test_interactions(spark, rel, exact, want):
    df = spark.createDataFrame([(0.95, rel, exact)], "jaro_winkler_norm double, price_rel_diff double, manufacturer_exact double")
    r = df.select(*[c.alias(k) for k, c in X.interaction_features().items()]).head()
    assert (r.high_name_sim_price_mismatch, r.disagreeing_fields) == want


def test_dangling_pairs(spark):
    a = spark.createDataFrame([(1, "x", None, None)], ENTITY)
    pairs = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "ltable_id long, rtable_id long, label int")
    assert [tuple(r) for r in X.dangling(pairs, a, a).collect()] == [(1, 2)]
    assert X.pair_features(pairs, a, a, check=False).count() == 1
    with pytest.raises(KeyError):
        X.pair_features(pairs, a, a)
    with pytest.raises(ValueError, match="more than once"):
        X.pair_features(pairs.limit(1), a, a.union(a))
    assert X.pair_features(pairs, a, a, check=False).where(F.col("emb_name_cosine").isNotNull()).count() == 0
    none = spark.createDataFrame([(None, 1, 1), (1, 1, 1)], "ltable_id long, rtable_id long, label int")
    assert [tuple(r) for r in X.dangling(none, a, a).collect()] == [(None, 1)]


def test_long_manufacturers(spark):
    r = row(spark, ("x", "The " + "very long maker's name " * 9, 1.0), ("x", "very long makers name " * 9, 1.0))
    assert 0.8 < r.manufacturer_jw < 1.0
