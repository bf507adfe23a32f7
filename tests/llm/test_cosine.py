import random
from collections import Counter

from matchloom.llm.cosine import overlap_counts, split_overlaps

LISTING = "id long, title string, manufacturer string, price double, key string"


def overlaps(spark, evaluation, train, a, b):
    e = spark.createDataFrame(evaluation, "pair_id long, ltable_id long, rtable_id long, source string, split string, l string")
    t = spark.createDataFrame(train, "pair_id long, ltable_id long, rtable_id long, key string")
    return sorted((r.eval_pair, r.train_pair) for r in split_overlaps(e, t, spark.createDataFrame(a, LISTING), spark.createDataFrame(b, LISTING)).collect())


def test_split_overlaps(spark):
    a = [
        (1, "Bivuleth v10 Premium - original", None, 1.0, ""), (2, "BIVULETH V10  PREMIUM original!", None, None, ""), (3, "Bivulteh v10 Premium - original", None, 2.0, ""),
        (4, "Bivuleth v11 Premium - original", None, 1.0, ""), (5, "Bivuleth version 10 Premium - original", None, 1.0, ""), (6, None, None, 1.0, ""), (7, None, None, 1.0, ""), (8, "z" * 4000, None, 1.0, ""),
    ]
    b = [(1, "thumb drive Myhirit 64 GB red", None, None, ""), (2, "Thumb Drive Myhirt 64GB red", None, None, ""), (3, "thumb drive Myhirit 64 GB blue", None, None, "")]
    train = [(10, 1, 1, ""), (11, 1, 1, ""), (12, 6, 1, ""), (13, None, 1, ""), (14, 77, 3, ""), (15, 8, 3, "")]
    evaluation = [(20, 1, 1, "s", "valid", ""), (21, 2, 2, None, "test", ""), (22, 3, 1, "s", "test", ""), (23, 4, 1, "s", "test", ""), (24, 5, 1, "s", "test", ""), (25, 1, 3, "s", "test", ""), (26, 7, 1, "s", "test", ""), (27, 6, 2, "s", "test", ""), (28, 77, 3, "s", "test", ""), (29, 1, None, "s", "test", ""), (5, 8, 3, "s", "test", "")]
    want = [(5, 15), (20, 10), (20, 11), (21, 10), (21, 11), (22, 10), (22, 11), (27, 12), (28, 14)]
    assert overlaps(spark, evaluation, train, a, b) == want
    assert overlaps(spark, evaluation, [], a, b) == [] == overlaps(spark, [], train, a, b)
    assert overlaps(spark, evaluation[:1], train[:1], [], []) == [(20, 10)]
    names = {p: (s, x) for p, _, _, x, s, _ in evaluation}
    tables = [spark.createDataFrame(t, LISTING) for t in (a, b)]
    e = spark.createDataFrame(evaluation, "pair_id long, ltable_id long, rtable_id long, source string, split string, l string")
    report = overlap_counts(e, spark.createDataFrame(train, "pair_id long, ltable_id long, rtable_id long, key string"), *tables)
    links, hit, every = Counter(names[x] for x, _ in want), Counter(names[x] for x in {x for x, _ in want}), Counter(names.values())
    assert {(r.split, r.source): (r["rows"], r.overlapping, r.links) for r in report.collect()} == {k: (n, hit[k], links[k]) for k, n in every.items()}


def test_titles_move_and_not_their_trigrams(spark, monkeypatch):
    from matchloom.llm import cosine as K
    from matchloom.llm.listing_text import near
    from matchloom.operators import cosine as core

    r, rows = random.Random(2), []
    for k in range(240):
        text = "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 30)))
        if k % 3 == 2:  # the last title with a letter swapped or left out
            text = rows[-1][5]
            i = r.randrange(len(text))
            text = text[:i] + text[i + 1 : i + 2] + text[i : i + 1] + text[i + 2 :] if k % 2 else text[:i] + text[i + 1 :]
        rows.append((k, "a", f"f{k // 120}", "", "", text, k % 2 == 0, k % 5 != 0))
    keys = spark.createDataFrame(rows, "key long, side string, facts string, forms string, model string, squeezed string, tested boolean, trained boolean")
    stored, moved = K.stored, []

    def watched(df):
        out = stored(df)
        moved.append(out.count())
        return out

    for module in (K, core):
        monkeypatch.setattr(module, "stored", watched)
    found = {chunk: (monkeypatch.setattr(K, "CHUNK", chunk, raising=False), {(x.key_1, x.key_2) for x in K.entered_again(keys).collect()})[1] for chunk in (4000, 7)}
    # no step writes a row for each trigram of each title, as the inverted lists did
    assert max(moved[: len(moved) // 2]) < 0.75 * sum(len(text) for *_, text, _, _ in rows)
    assert found[4000] == found[7] and {(k, k) for k, *_, text, e, t in rows if e and t and text} <= found[7]
    close = {(x[0], y[0]) for x in rows for y in rows if x[2] == y[2] and x[6] and y[7] and near(x[5], y[5], 4) <= min(4, max(len(x[5]), len(y[5])) // 4)}
    assert len(found[7]) > 100 and found[7] <= close
