import random

from matchloom.llm.canonical import BKTree, map_values, metric, typed_makers

MAKERS = [(1, "Gructard"), (2, "Crarlalloda Media"), (3, "Crarlalloda Games"), (4, "Brindoské Labs"), (5, "Quoppisch & Molvisch Media"), (6, "The Vintor Works"), (7, None)]
TYPED = {
    "by GRUCTARD Inc.": 1, "Gructadr": 1, "Crarlalloda": 0, "crarlaloda media": 2, "Games, Crarlalloda": 3, "Brindoske_Labs (OEM)": 4, "B​rindoské": 4, "Q.M.M.": 5, "Quoppisch-Molvisch Media GmbH": 5, "vintor works ltd": 6,
    "0815": 0, "box of 4": 0, "Zuverlon": 0, "x" * 5000: 0,
}


def test_tree_finds_all(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(150)})
    tree = BKTree([(w, i) for i, w in enumerate(words)])
    for probe in ["", "abc", "ccab", *words[:20]]:
        for most in (0, 1, 2):
            assert sorted((d, k) for d, k, _ in tree.within(probe, most)) == sorted((metric(probe, w), w) for w in words if metric(probe, w) <= most)


def test_one_tree_and_shards_agree(spark):
    values = spark.createDataFrame([(v, 1) for v in [*TYPED, *TYPED, None, "", " ", "N/A", "-", "not specified"]], "v string, ref int")
    reference = spark.createDataFrame(MAKERS, "maker_id long, name string")
    one = {r.value: r.ref_id for r in map_values(values, reference, "v", "maker_id", "name").collect()}
    assert {k: v or 0 for k, v in one.items()} == TYPED
    assert one == {r.value: r.ref_id for r in map_values(values, reference, "v", "maker_id", "name", tree_entries=2).collect()}
    assert map_values(values.limit(0), reference, "v", "maker_id", "name").count() == 0
    assert {r.ref_id for r in map_values(values, reference.limit(0), "v", "maker_id", "name").collect()} == {None}


def test_typed_makers(spark):
    a = spark.createDataFrame([(1, "by Gructard", 0), (1, "by Gructard", 1), (2, "Gructard", 0), (3, None, 0), (4, "unknown", 0)], "id long, manufacturer string, value int")
    b = spark.createDataFrame([(1, "Nobody", "x")], "id long, manufacturer string, name string")
    got = sorted((r.side, r.id, r.maker_id) for r in typed_makers(a, b, spark.createDataFrame(MAKERS, "maker_id long, name string")).collect())
    assert got == [("a", 1, 1), ("a", 1, 1), ("b", 1, 0)]
