import math
import random
from collections import Counter

import pytest

from matchloom.operators import blocking as B

A = [(0, "adobe photoshop cs3"), (1, "microsoft word 2007"), (2, "angry birds game"), (3, "norton antivirus 2023")]
Z = [(10, "photoshop cs3 adobe"), (11, "microsoft office word 2007 upgrade"), (12, "candy crush saga mobile"), (13, "norton antivirus plus 2023 edition")]
LABELS = [(0, 10, 1), (1, 11, 1), (2, 12, 0), (3, 13, 1)]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(A, "id long, title string"), spark.createDataFrame(Z, "id long, title string")


def pairs(df):
    return {(r.ltable_id, r.rtable_id) for r in df.collect()}


def test_candidates(spark, tables):
    low, high = pairs(B.generate_candidates(*tables, 0.01)), pairs(B.generate_candidates(*tables, 0.5))
    assert (0, 10) in low and high <= low
    assert {x for x, _ in low} <= {0, 1, 2, 3} and {y for _, y in low} <= {10, 11, 12, 13}
    assert len(pairs(B.generate_candidates(*tables, 0.0))) < 16
    empty = spark.createDataFrame([], "id long, title string")
    assert pairs(B.generate_candidates(empty, empty, 0.1)) == set() == pairs(B.generate_candidates(tables[0], empty, 0.1))


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["disk", "drive", "backup", "drives", "disc", "tool", "kit", "pro"]
    rows = [[(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 4))) or None) for i in range(25)] for _ in range(2)]
    grams = [{i: Counter(f" {w} "[k : k + 3] for w in (t or "").split() for k in range(len(w))) for i, t in side} for side in rows]
    df = Counter(g for side in grams for c in side.values() for g in c)
    weight = lambda c: {g: n * (math.log(51 / (1 + df[g])) + 1) for g, n in c.items()}
    vec = [{i: weight(c) for i, c in side.items()} for side in grams]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for t in (0.2, 0.5, 0.9):
        want = {(i, j) for i, x in vec[0].items() for j, y in vec[1].items() if set(x) & set(y) and sum(w * y.get(g, 0) for g, w in x.items()) / norm(x) / norm(y) >= t - 1e-9}
        assert pairs(B.generate_candidates(*[spark.createDataFrame(s, "id long, title string") for s in rows], t)) == want


def ceiling(spark, found, labels):
    f = spark.createDataFrame(found, "ltable_id long, rtable_id long")
    return B.recall_ceiling(f, spark.createDataFrame(labels, "ltable_id long, rtable_id long, label int")).head().ceiling


def test_recall_ceiling(spark, tables):
    true = [(0, 10), (1, 11), (3, 13)]
    assert ceiling(spark, true, LABELS) == 1.0
    assert ceiling(spark, [(2, 12)], LABELS) == 0.0
    assert ceiling(spark, [(0, 10), (0, 10)], LABELS) == pytest.approx(1 / 3)
    assert ceiling(spark, true, [(2, 12, 0)]) == 0.0
    labels = spark.createDataFrame(LABELS, "ltable_id long, rtable_id long, label int")
    for t in (0.05, 0.5, 0.9):
        assert B.recall_ceiling_at(B.tfidf(*tables), labels, t).head() == B.recall_ceiling(B.generate_candidates(*tables, t), labels).head()
    assert B.recall_ceiling(B.generate_candidates(*tables, 0.05), spark.createDataFrame(LABELS, "ltable_id long, rtable_id long, label int")).head().ceiling > 0
    assert B.reduction(B.generate_candidates(*tables, 0.5), *tables).head().reduction > 0.7


def test_hot_terms_are_split(spark, monkeypatch):
    from matchloom.operators import cosine as K

    rows = [(i, t, w) for i in range(60) for t, w in ((1, 0.6), (100 + i % 7, 0.8))]
    sides = [spark.createDataFrame(rows, "key long, term long, weight double")] * 2
    want = {(i, j) for i in range(60) for j in range(60)}
    for postings, meetings in ((2000, 1e9), (5, 1e9), (5, 0)):
        monkeypatch.setattr(K, "POSTINGS", postings)
        assert {(r.key_1, r.key_2) for r in K.cosine_join(*sides, 0.3, meetings).collect()} == want
        assert {(r.key_1, r.key_2) for r in K.cosine_join(*sides, 0.5, meetings).collect()} == {(i, j) for i, j in want if i % 7 == j % 7}


@pytest.mark.parametrize("meetings", [0, 1e9])
def test_join_against_brute_force(spark, meetings, monkeypatch):
    from matchloom.operators import cosine as K

    monkeypatch.setattr(K, "BLOCK", 15)
    r = random.Random(4)

    def vectors(n):
        out = {}
        for k in range(n):
            v = {f"t{r.randrange(12)}": r.random() + 0.1 for _ in range(r.randrange(1, 6))}
            norm = math.sqrt(sum(x * x for x in v.values()))
            out[f"k{k}"] = {t: x / norm for t, x in v.items()}
        return out

    left, right = vectors(40), vectors(40)
    left["k40"] = dict(right["k0"])
    bad = [(None, "t1", 1.0, ""), ("k99", None, 1.0, ""), ("k98", "t1", None, "")]
    frames = [spark.createDataFrame([(k, t, w, "x") for k, v in side.items() for t, w in v.items()] + bad, "key string, term string, weight double, rest string") for side in (left, right)]
    for t in (0.1, 0.5, 0.9):
        got = {(x.key_1, x.key_2): x.cosine for x in K.cosine_join(*frames, t, meetings).collect()}
        want = {(i, j): c for i, x in left.items() for j, y in right.items() if (c := sum(w * y.get(k, 0) for k, w in x.items())) >= t - 1e-9}
        assert got == pytest.approx(want)
    assert K.cosine_join(frames[0].limit(0), frames[1], 0.5, meetings).count() == 0


def test_blocks_are_written_once(spark, monkeypatch):
    from matchloom.operators import cosine as K

    sides = [spark.createDataFrame([(i, t, w) for i in range(n) for t, w in ((1, 0.6), (100 + i % 7, 0.8))], "key long, term long, weight double") for n in (90, 60)]
    moved = []
    for block in (1000, 10):
        monkeypatch.setattr(K, "BLOCK", block)
        monkeypatch.setattr(K, "PAIRS", block)
        out = K.cosine_join(*sides, 0.5, 0)
        found = {(r.key_1, r.key_2) for r in out.collect()}
        assert found == {(i, j) for i in range(90) for j in range(60) if i % 7 == j % 7}
        # nothing is repeated for each block of the other side
        moved.append(out._jdf.queryExecution().optimizedPlan().toString().count("Generate"))
    assert moved == [0, 0]


def moved(spark) -> int:
    """Rows written to shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    none, empty = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(none, False, False, empty, none)))


def test_block_stats_move_texts_and_no_entries(spark, tmp_path, monkeypatch):
    from matchloom.operators import cosine as K
    from matchloom.plans.queries import QUERIES

    monkeypatch.setattr(K, "BLOCK", 150)
    r = random.Random(6)
    words = ["".join(r.choice("abcdef") for _ in range(8)) for _ in range(40)]
    sides = [[(i, " ".join(r.choice(words) for _ in range(6))) for i in range(n)] for n in (400, 300)]
    for name, rows in zip(("tablea", "tableb"), sides, strict=True):
        spark.createDataFrame(rows, "id long, title string").write.parquet(f"{tmp_path}/{name}.parquet")
    before = moved(spark)
    got = QUERIES["er_block_stats"](spark, str(tmp_path)).head()
    entries = sum(len({f" {w} "[k : k + 3] for w in t.split() for k in range(len(w))}) for side in sides for _, t in side)
    assert moved(spark) - before < entries / 2
    found = QUERIES["er_block_candidates"](spark, str(tmp_path)).collect()
    assert got.candidates == len(found) == len({(x.ltable_id, x.rtable_id) for x in found}) > 0
    assert found and all(x.score >= 0.38 - 1e-6 for x in found)


def test_texts_meet_as_their_vectors(spark, monkeypatch):
    from matchloom.operators import cosine as K
    from matchloom.operators import gram_blocks as G

    monkeypatch.setattr(K, "BLOCK", 25)
    r = random.Random(8)
    words = ["disk", "drive", "Ünï", "𝒳𝒴z", "disc", "a1", "kit", "日本", "x", "pro"]
    text = lambda: r.choice([None, "", " - ", *[" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(9)]])
    # ids that repeat, rows without id and grams that only one side has
    sides = [spark.createDataFrame([(r.choice([None, *[f"k{k}" for k in range(30)]]), f"{text() or ''} {extra}") for _ in range(40)] + [("e", None), ("f", "")], "id string, title string") for extra in ("", "only")]
    want = {(x.ltable_id, x.rtable_id): x.score for x in B.similarity_join(B.tfidf(*sides), 0.4).collect()}
    got = [tuple(x) for x in G.meet(*sides, 0.4, "id", "title", meetings=0).collect()]
    assert len(got) == len(want) > 0 and {(i, j): c for i, j, c in got} == pytest.approx(want)
    assert G.meet(*sides, 0.4, "id", "title", counted=True, meetings=0).head().candidates == len(want)
    assert G.meet(*sides, 0.4, "id", "title", meetings=1e9) is None


def test_gram_counts_are_not_broadcast(spark):
    """The grams exploded from titles are many times as large as the optimizer takes them for."""
    from matchloom.operators.blocking import tfidf

    t = spark.createDataFrame([(1, "usb stick"), (2, "memory stick")], "id long, title string")
    plan = tfidf(t, t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [gram#" in plan and "BroadcastHashJoin" not in plan
