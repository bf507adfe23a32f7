import pytest

from matchloom.plans.queries import QUERIES, SQL


def test_table_b_is_profiled(spark, tmp_path):
    spark.createDataFrame([(1, "x", None, 5.0), (2, None, None, 15.0), (3, "y", "m", None), (4, "z", None, 900.0)], "id long, title string, manufacturer string, price double").write.parquet(f"{tmp_path}/tableb.parquet")
    assert {(r.side, r.column, r.nulls) for r in QUERIES["er_null_profile_b"](spark, str(tmp_path)).collect()} == {("b", "title", 1), ("b", "manufacturer", 3), ("b", "price", 1)}
    assert QUERIES["er_describe_b"](spark, str(tmp_path)).head()["count"] == 3
    assert sum(r.n for r in QUERIES["er_histogram_b"](spark, str(tmp_path)).collect()) == 3


@pytest.mark.parametrize("name", ["er_null_profile", "er_describe", "er_histogram"])
def test_sql_of_both_differs_in_the_table_only(name):
    assert SQL[name + "_b"] == SQL[name].replace("tablea", "tableb").replace("'a' side", "'b' side")
