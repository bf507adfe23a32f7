import random

import pytest

from pyspark.sql import functions as F

from matchloom.llm.components import block_of, connected_components, exchanged, link_groups


def by_union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("blocks", [1, 3])
def test_against_union_find(spark, blocks):
    r = random.Random(blocks)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 180), r.randrange(100, 180)) for _ in range(70)] + [(500, x) for x in range(501, 560)] + [(900, 900), (5, 5)]
    links += links[:10]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in links] + [(None, 1, "", ""), (7, None, "", "")], "a long, b long, v string, p string")
    got = {x.vertex: x.component for x in connected_components(df, "a", "b", blocks=blocks).collect()}
    assert got == by_union_find(links)


@pytest.mark.parametrize("blocks", [16, 64])
def test_exchange_is_bounded_by_vertices(spark, blocks):
    """A chain cut into stars of ten, every star's representative moved on: no more rows than vertices at any number of blocks."""
    found = spark.range(2000).select(F.col("id").alias("v"), (F.floor(F.col("id") / 10) * 10).alias("p"))
    moved = found.select(F.col("p").alias("u"), (F.col("p") - 10).alias("v")).distinct()
    rows = exchanged(found, moved, blocks)
    assert 200 <= rows.count() <= 2000
    cells = found.select(F.col("p").alias("u"), block_of("v", blocks).alias("row")).distinct()
    assert cells.join(rows, ["u", "row"], "left_anti").count() == 0


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_link_groups(spark):
    rows = [(1, 10, 1), (1, 10, 0), (2, 10, 1), (3, 30, 0), (4, 40, None), (5, 50, 1), (5, 51, 1), (None, 1, 1), (9, None, 1), (5, 50, 1), (-7, 50, 1)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "ltable_id long, rtable_id long, label int, side string, component int")
    got = {(r.side, r.id): r.group_id for r in link_groups(df).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("b", 10): 1, ("a", 5): -7, ("a", -7): -7, ("b", 50): -7, ("b", 51): -7}
