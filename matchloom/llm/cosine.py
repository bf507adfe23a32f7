"""Overlaps between evaluation and training splits: titles that are a few edits apart and whose weighted trigrams reach a cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cosine import SLACK, dot_products, ranges
from ..runtime import parallel, salted_join, stored
from .listings import both_tables, read_listings
from .resolve import vertex


def unit_vectors(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, term, weight)`` for the ``wanted(key)`` of ``texts(key, scope, squeezed)``: the text's trigrams, each once, weighted by rarity.

    A term is a trigram within the scope, a 64-bit number; rarity is that of the trigram over all texts.
    """
    padded = F.concat(F.lit("^"), F.col("squeezed"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("squeezed")), lambda i: F.substring(padded, i, 3)))
    titled = texts.where("squeezed <> ''")
    rarity = stored(titled.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.log(1 + F.lit(float(texts.count())) / F.count(F.lit(1))).alias("idf")))
    each = titled.join(wanted, "key", "left_semi").select("key", "scope", F.explode(grams).alias("gram"))
    weighed = each.join(rarity, "gram").select("key", F.xxhash64("scope", "gram").alias("term"), F.col("idf").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return weighed.select("key", "term", (F.col("w") / norm).alias("weight"))


#: Least cosine of two titles of which one is the other entered again, and edits that their letters and digits may differ by.
ENTERED_AGAIN_COSINE = 0.3
ENTERED_AGAIN_EDITS = 4
_SCOPE = ["side", "facts", "forms", "model"]
#: Titles of one scope and split that meet those of the other at once, titles that one group of cells takes on average, and pairs compared at once.
CHUNK = 4_000
GROUP = 20_000
AT_ONCE = 200_000


def edit_distances(flat: np.ndarray, one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray, most: int) -> np.ndarray:
    """The distance of ``listing_text.near``, or ``most + 1``, for many pairs of texts at once.

    Texts are ``n`` characters of ``flat`` from ``one`` and ``two``.  Only places within ``most`` of the diagonal are worked out, and
    pairs are left as soon as they end or are known to be further apart.
    """
    width, far, top = 2 * most + 1, most + 1, len(flat) - 1
    out = np.full(len(one), far, dtype=np.int16)
    if not len(one):
        return out
    near_by = np.abs(n_one - n_two) <= most
    ends = near_by & (n_one == 0)
    out[ends] = n_two[ends]
    at = np.flatnonzero(near_by & (n_one > 0))
    row = np.full((width, len(at)), far, dtype=np.int16)
    row[most:] = np.arange(most + 1)[:, None]
    older, last = row, None
    # seen[d]: the character of the second text before place r + d - most
    seen = [flat[np.clip(two[at] + d - most - 1, 0, top)] for d in range(width)]
    r = 0
    while len(at):
        r += 1
        seen = [*seen[1:], flat[np.clip(two[at] + r + most - 1, 0, top)]]
        char = flat[one[at] + r - 1]
        new = np.full((width, len(at)), far, dtype=np.int16)
        for d in range(max(0, most - r), width):
            c = r + d - most
            if c == 0:
                new[d] = r
                continue
            v = row[d] + (char != seen[d])
            if d + 1 < width:
                np.minimum(v, row[d + 1] + 1, out=v)
            if d:
                np.minimum(v, new[d - 1] + 1, out=v)
                if r > 1 and c > 1:
                    np.minimum(v, np.where((char == seen[d - 1]) & (last == seen[d]), older[d] + 1, far), out=v)
            new[d] = np.minimum(v, far)
        older, row, last = row, new, char
        done = n_one[at] == r
        if done.any():
            out[at[done]] = row[(n_two - n_one)[at[done]] + most, np.flatnonzero(done)]
        stay = ~done & (row.min(axis=0) <= most)
        if not stay.all():
            at, older, row, last, seen = at[stay], older[:, stay], row[:, stay], last[stay], [s[stay] for s in seen]
    return out


def _few_edits(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs ``(key_1, key_2)`` of each cell's two kinds of titles that are at most ``ENTERED_AGAIN_EDITS`` and a quarter of the longer one's length apart."""
    cell = frame.groupby(["scope", "b1", "b2"], sort=False).ngroup().to_numpy()
    texts, keys, second = frame["squeezed"].tolist(), frame["key"].to_numpy(), frame["second"].to_numpy(bool)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.zeros((len(texts), 32), dtype=np.int16)
    np.add.at(letters, (np.repeat(np.arange(len(texts)), size), flat % 32), 1)
    one, two = np.flatnonzero(~second), np.flatnonzero(second)
    two = two[np.argsort(cell[two], kind="stable")]
    low, high = (np.searchsorted(cell[two], cell[one], side) for side in ("left", "right"))
    total, at, rows = np.cumsum(high - low), 0, []
    while at < len(one):
        # a part holds about AT_ONCE pairs, or all of one title
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        i, j = np.repeat(one[at:to], (high - low)[at:to]), two[ranges(low[at:to], high[at:to])]
        at = to
        most = np.minimum(ENTERED_AGAIN_EDITS, np.maximum(size[i], size[j]) // 4)
        fit = np.abs(size[i] - size[j]) <= most
        i, j, most = i[fit], j[fit], most[fit]
        # letters that only one of two texts has take an edit each
        more = letters[i] - letters[j]
        fit = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= most
        i, j, most = i[fit], j[fit], most[fit]
        fit = edit_distances(flat, start[i], size[i], start[j], size[j], ENTERED_AGAIN_EDITS) <= most
        rows.append((keys[i[fit]], keys[j[fit]]))
    return pd.DataFrame({c: np.concatenate([r[n] for r in rows]) if rows else np.empty(0, np.int64) for n, c in enumerate(("key_1", "key_2"))})


def few_edits_apart(tested: DataFrame, trained: DataFrame) -> DataFrame:
    """``(key_1, key_2)`` for ``(key, scope, squeezed)`` of either side: texts of one scope that are a few edits apart.

    The titles themselves are moved, not their trigrams: those of a scope go to one cell, or, where there are many, to cells
    in which a chunk of one side meets a chunk of the other, so no task holds a large scope.
    """
    spark = tested.sparkSession
    counts = [side.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(f"p{n}")) for n, side in enumerate((tested, trained), 1)]
    parts = stored(counts[0].join(counts[1], "scope"))
    sides = []
    for n, side in enumerate((tested, trained), 1):
        own, other = F.pmod(F.xxhash64("key"), F.col(f"p{n}")).cast("int").alias(f"b{n}"), F.explode(F.sequence(F.lit(0), F.col(f"p{3 - n}") - 1)).alias(f"b{3 - n}")
        sides.append(side.join(parts, "scope").select("key", "scope", "squeezed", own, other, F.lit(n == 2).alias("second")))
    placed = stored(sides[0].unionByName(sides[1]))
    tasks = parallel(spark)
    groups = max(tasks, -(-placed.count() // GROUP))
    # titles are few bytes and much work, so their partitions must not be put together by size
    cut = placed.withColumn("group", F.pmod(F.xxhash64("scope", "b1", "b2"), F.lit(groups)).cast("int")).repartition(tasks, "group")
    return cut.groupBy("group").applyInPandas(_few_edits, "key_1 long, key_2 long")


def entered_again(keys: DataFrame) -> DataFrame:
    """``(key_1, key_2)``: titles of an evaluation record and of a training record that are one listing, once or entered twice.

    ``keys(key, side, facts, forms, model, squeezed, tested, trained)`` has one row per spelling; one that both sides
    have meets itself.  Titles meet within the stated facts and their wording, and facts stated on one side only need no
    look; of titles that are a few edits apart those stay whose weighted trigrams reach the cosine.  Both tests have to
    hold, and the edits leave few pairs, so only these need vectors.
    """
    shared = keys.groupBy(*_SCOPE).agg(F.max("tested").alias("t1"), F.max("trained").alias("t2")).where("t1 and t2").select(*_SCOPE)
    met = stored(keys.join(shared, _SCOPE, "left_semi").select("key", F.xxhash64(*_SCOPE).alias("scope"), "squeezed", "tested", "trained"))
    sides = [met.where(f"{s} and squeezed <> ''").select("key", "scope", "squeezed") for s in ("tested", "trained")]
    pairs = stored(few_edits_apart(*sides))
    other = pairs.where("key_1 <> key_2")
    vectors = stored(unit_vectors(met, other.select(F.explode(F.array("key_1", "key_2")).alias("key")).distinct()))
    near = dot_products(other, vectors, vectors).where(F.col("cosine") >= ENTERED_AGAIN_COSINE - SLACK).select("key_1", "key_2")
    # titles without a letter or digit have no vector; they meet what has none either, under the same facts
    bare = met.where("squeezed = ''")
    none = bare.where("tested").select("scope", F.col("key").alias("key_1")).join(bare.where("trained").select("scope", F.col("key").alias("key_2")), "scope").select("key_1", "key_2")
    return pairs.where("key_1 = key_2").unionByName(near).unionByName(none)


def _same_records(tested: DataFrame, trained: DataFrame, tablea: DataFrame, tableb: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tested, trained, same)``: the rows with their records replaced by keys, and the keys ``(key_1, key_2)`` of equal records.

    The key of a record is the smallest vertex whose title has the same letters, digits and facts, or the record's own
    where it has no title or is not in its table.
    """

    def records(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("l", "r")).alias("v")).distinct()

    used = records(tested).select("v", F.lit(True).alias("tested"), F.lit(False).alias("trained")).unionByName(records(trained).select("v", F.lit(False).alias("tested"), F.lit(True).alias("trained")))
    used = stored(used.groupBy("v").agg(F.max("tested").alias("tested"), F.max("trained").alias("trained")))
    listings = stored(both_tables(tablea, tableb).withColumn("v", vertex(F.col("side"), F.col("id"))).join(used.select("v"), "v", "left_semi").select("side", "id", "title"))
    read = read_listings(listings).select(*_SCOPE, "squeezed", vertex(F.col("side"), F.col("id")).alias("v"))
    titled = stored(read.join(used, "v"))
    text = [*_SCOPE, "squeezed"]
    keys = stored(titled.groupBy(*text).agg(F.min("v").alias("key"), F.max("tested").alias("tested"), F.max("trained").alias("trained")))
    names = stored(salted_join(titled, keys.select(*text, "key"), text).select("v", "key"))
    untitled = used.where("tested and trained").join(names, "v", "left_anti").select(F.col("v").alias("key_1"), F.col("v").alias("key_2"))
    same = stored(entered_again(keys).unionByName(untitled))

    def as_keys(rows: DataFrame) -> DataFrame:
        for end in ("l", "r"):
            rows = rows.join(names.select(F.col("v").alias(end), F.col("key").alias(f"{end}_key")), end, "left").withColumn(end, F.coalesce(f"{end}_key", end)).drop(f"{end}_key")
        return rows

    return stored(as_keys(tested)), stored(as_keys(trained)), same


def _ends(pairs: DataFrame, *more: str | Column) -> DataFrame:
    kept = pairs.where("pair_id is not null and ltable_id is not null and rtable_id is not null")
    return kept.select("pair_id", vertex(F.lit("a"), F.col("ltable_id")).alias("l"), vertex(F.lit("b"), F.col("rtable_id")).alias("r"), *more)


def _combinations(tested: DataFrame, trained: DataFrame, same: DataFrame) -> DataFrame:
    """``(l, r, l2, r2)``: pairs of evaluation records with pairs of training records that are the same, each once."""
    combos = tested.select("l", "r").distinct().join(same.select(F.col("key_1").alias("l"), F.col("key_2").alias("l2")), "l").join(same.select(F.col("key_1").alias("r"), F.col("key_2").alias("r2")), "r")
    return combos.join(trained.select(F.col("l").alias("l2"), F.col("r").alias("r2")).distinct(), ["l2", "r2"], "left_semi")


def split_overlaps(evaluation: DataFrame, train: DataFrame, tablea: DataFrame, tableb: DataFrame) -> DataFrame:
    """``(eval_pair, split, source, train_pair)``: every evaluation row with every training row on the same two records.

    ``evaluation`` has pair_id, ltable_id, rtable_id, source and split; ``train`` the first three.  Records of a table are
    the same if they have the same id or one is the other entered again (see ``entered_again``); a record without
    title, or missing from its table, is only the same as itself.  Labels play no role and repeated rows count each;
    rows without one of their ids overlap with nothing.

    The joins are equi-joins with one partner per record and side, so that the rows of a frequent record can be split.
    """
    tested, trained, same = _same_records(_ends(evaluation, "split", "source"), _ends(train), tablea, tableb)
    seen = _combinations(tested, trained, same)
    other = trained.select(F.col("l").alias("l2"), F.col("r").alias("r2"), F.col("pair_id").alias("train_pair"))
    return tested.join(seen, ["l", "r"]).join(other, ["l2", "r2"]).select(F.col("pair_id").alias("eval_pair"), "split", "source", "train_pair")


def overlap_counts(evaluation: DataFrame, train: DataFrame, tablea: DataFrame, tableb: DataFrame) -> DataFrame:
    """``(split, source, rows, overlapping, links)``: rows of each split and source, how many overlap with training rows, and in how many combinations.

    Rows of the same two records are counted on either side before they meet, so no combination of rows is made.
    """
    tested, trained, same = _same_records(_ends(evaluation, "split", "source"), _ends(train), tablea, tableb)
    many = trained.groupBy(F.col("l").alias("l2"), F.col("r").alias("r2")).agg(F.count(F.lit(1)).alias("m"))
    per_pair = _combinations(tested, trained, same).join(many, ["l2", "r2"]).groupBy("l", "r").agg(F.sum("m").alias("m"))
    own = tested.groupBy("l", "r", "split", "source").agg(F.count(F.lit(1)).alias("n"))
    per = own.join(per_pair, ["l", "r"]).groupBy("split", "source").agg(F.sum("n").alias("overlapping"), F.sum(F.col("n") * F.col("m")).alias("links"))
    rows = evaluation.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"))
    matched = rows["split"].eqNullSafe(per["split"]) & rows["source"].eqNullSafe(per["source"])
    counts = [F.coalesce(per[c], F.lit(0)).alias(c) for c in ("overlapping", "links")]
    return rows.join(per, matched, "left").select(rows["split"], rows["source"], "rows", *counts)
