"""Join of weighted vectors whose cosine reaches a threshold: inverted lists, pruned by largest weights and residual norms."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallel, salted_join, stored

#: A score this close below the threshold still counts, so that the order of summing does not decide.
SLACK = 1e-9
#: Postings of one term that one task joins.
POSTINGS = 2_000
#: Meetings in common terms for each entry, up to which pairs are made by joining on the term; beyond it blocks of vectors meet.
MEETINGS = 8
#: Vectors of a block.
BLOCK = 20_000
#: Pairs that two blocks give at once.
PAIRS = 200_000
#: Share of the threshold that a block's unindexed terms may add to a dot product together.
UNINDEXED = 0.3


def _postings(vectors: DataFrame, terms: DataFrame, most: str, threshold: float, n: int) -> DataFrame:
    """Indexed entries ``(term, key_n, w_n, norm_n, bound_n)``: weight, norm of the vector's more frequent terms, and what these can add to a dot product at most.

    Terms are ordered from the most to the least frequent.  An entry is indexed if the terms up to it can bring a dot
    product to the threshold, by the largest weights on the other side and by their own norm.
    """
    up = Window.partitionBy("key").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    square, gain = F.col("weight") * F.col("weight"), F.col("weight") * F.col(most)
    summed = vectors.join(terms.select("term", "df", most), "term").withColumns({"_square": F.sum(square).over(up), "_gain": F.sum(gain).over(up)})
    opened = summed.where(F.least(F.sqrt("_square"), F.col("_gain")) >= threshold - SLACK)
    before = F.greatest(F.col("_square") - square, F.lit(0.0)), F.greatest(F.col("_gain") - gain, F.lit(0.0))
    return opened.select("term", F.col("key").alias(f"key_{n}"), F.col("weight").alias(f"w_{n}"), F.sqrt(before[0]).alias(f"norm_{n}"), before[1].alias(f"bound_{n}"))


def dot_products(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs(key_1, key_2)`` with ``cosine``, the dot product over all terms of both vectors; pairs without vectors are left out."""
    entries = F.collect_list(F.struct("term", "weight"))
    x = left.groupBy(F.col("key").alias("key_1")).agg(entries.alias("x"))
    y = right.groupBy(F.col("key").alias("key_2")).agg(F.map_from_entries(entries).alias("y"))
    both = pairs.join(x, "key_1").join(y, "key_2")
    dot = F.aggregate("x", F.lit(0.0), lambda acc, e: acc + e["weight"] * F.coalesce(F.col("y")[e["term"]], F.lit(0.0)))
    return both.select("key_1", "key_2", dot.alias("cosine"))


def _block_index(vectors: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """``(key, tid, weight, open, rest)``: every entry, whether it is indexed, and what the vector's unindexed terms can add at most."""
    up = Window.partitionBy("key").orderBy(F.desc("df"), "tid").rowsBetween(Window.unboundedPreceding, 0)
    sums = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(up)), F.sum(F.col("weight") * F.col("most_1")).over(up)
    reach = vectors.join(terms.select("term", "tid", "df", "most_1"), "term").withColumns({"_norm": sums[0], "_gain": sums[1]}).withColumn("_reach", F.least("_norm", "_gain"))
    open_ = F.col("_reach") > UNINDEXED * threshold
    rest = F.coalesce(F.max(F.when(~open_, F.col("_reach"))).over(Window.partitionBy("key")), F.lit(0.0))
    return reach.select("key", "tid", "weight", open_.alias("open"), rest.alias("rest"))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """One row ``(block)``: the vectors, one after the other, with their terms numbered within the block."""
    frame = frame.sort_values("key", kind="stable")
    keys, starts = np.unique(frame["key"].to_numpy(), return_index=True)
    terms, code = np.unique(frame["tid"].to_numpy(), return_inverse=True)
    arrays = {"keys": keys, "bounds": np.append(starts, len(frame)), "terms": terms, "code": code.astype(np.int32), "weight": frame["weight"].to_numpy()}
    if "open" in frame:
        arrays |= {"open": np.packbits(frame["open"].to_numpy(bool)), "rest": frame["rest"].to_numpy()[starts]}
    return pd.DataFrame({"block": [pickle.dumps(arrays, protocol=5)]})


def block_pairs(left: dict, right: dict, threshold: float) -> Iterator[tuple]:
    """The pairs of two blocks: sums over the inverted lists of the right one, one vector of the left at a time; what the unindexed rest may bring to the threshold is summed in full."""
    names, starts, ends = right["keys"], right["bounds"][:-1], right["bounds"][1:]
    terms, code, weight, rest = right["terms"], right["code"], right["weight"], right["rest"]
    indexed = np.flatnonzero(right["open"])
    indexed = indexed[np.argsort(code[indexed], kind="stable")]
    bounds = np.searchsorted(code[indexed], np.arange(len(terms) + 1))
    listed, listed_weight = np.repeat(np.arange(len(names)), ends - starts)[indexed], weight[indexed]
    place = np.searchsorted(terms, left["terms"])
    place[place == len(terms)] = 0
    at, known = place[left["code"]], (terms[place] == left["terms"])[left["code"]]
    sums, dense = np.zeros(len(names)), np.zeros(len(terms))
    least = threshold - SLACK - rest
    for key, a, b in zip(left["keys"], left["bounds"][:-1], left["bounds"][1:], strict=True):
        own, w = at[a:b][known[a:b]], left["weight"][a:b][known[a:b]]
        sums[:] = 0.0
        for t, x in zip(own, w, strict=True):
            i, j = bounds[t], bounds[t + 1]
            sums[listed[i:j]] += x * listed_weight[i:j]
        near = np.flatnonzero((sums >= least) & (sums > 0))
        if len(near):
            dense[own] = w
            spots = ranges(starts[near], ends[near])
            dots = np.add.reduceat(weight[spots] * dense[code[spots]], np.concatenate([[0], np.cumsum(ends[near] - starts[near])[:-1]]))
            dense[own] = 0.0
            fit = dots >= threshold - SLACK
            if fit.any():
                yield np.repeat(key, fit.sum()), names[near[fit]], dots[fit]


def batched(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks as batches of about ``PAIRS``."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows])) for i in range(3)], ["key_1", "key_2", "cosine"])

    rows, held = [], 0
    for some in found:
        rows.append(some)
        held += len(some[0])
        if held >= PAIRS:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def _meet(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for one, two in zip(given.column("one"), given.column("two"), strict=True):
                right = pickle.loads(two.as_buffer())
                right["open"] = np.unpackbits(right["open"], count=len(right["code"]))
                yield from batched(block_pairs(pickle.loads(one.as_buffer()), right, threshold))

    return meet


def _by_blocks(left: DataFrame, right: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """Every block of the left with every block of the right, each a single row of a stored table.

    A cartesian product reads both where they lie, so a vector is written once however many blocks it meets.
    """
    spark = left.sparkSession
    n = [v.select("key").distinct().count() for v in (left, right)]
    blocks = [max(1, -(-k // BLOCK)) for k in n]
    blocks[0] = max(blocks[0], -(-parallel(spark) // blocks[1]))
    one, two = left.join(terms.select("term", "tid"), "term").select("key", "tid", "weight"), _block_index(right, terms, threshold)
    packed = []
    for side, b in ((one, blocks[0]), (two, blocks[1])):
        placed = side.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(b)).cast("int"))
        packed.append(stored(placed.groupBy("b").applyInPandas(_block, "block binary")))
    # a left block for each task, which a row of the product holds with one of the right
    met = packed[0].toDF("one").repartition(blocks[0]).crossJoin(packed[1].toDF("two").hint("shuffle_replicate_nl"))
    kinds = [v.schema["key"].dataType.simpleString() for v in (left, right)]
    return met.mapInArrow(_meet(threshold), f"key_1 {kinds[0]}, key_2 {kinds[1]}, cosine double")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, meetings: float = MEETINGS) -> DataFrame:
    """``(key_1, key_2, cosine)`` for every pair of vectors that share a term and whose dot product reaches ``threshold``.

    Both sides hold unit vectors as rows ``(key, term, weight)`` with positive weights, one row for each key and term, and
    should be cheap to read again.  The result is exact, by either of two plans; the meetings of vectors in common
    terms are counted first.

    Where these are few, entries are joined on the term.  The rarest common term of a pair that reaches the threshold
    is indexed on both sides, and there the product of its weights and of the norms of what is more frequent, or what
    the largest weights leave to it, reaches the threshold too.  So most pairs are dropped where they meet, and what is
    left is summed in full.  A term that many vectors have is joined by as many tasks as its entries need.

    Where the terms are so frequent that pairs would outnumber the entries many times, blocks of vectors meet instead, and each
    meeting sums over inverted lists without making rows of the pairs.  Frequent terms are left out of the lists as long
    as the largest weights and their own norm hold them below a share of the threshold.

    Null keys, terms and weights are ignored; empty sides give an empty result.
    """
    ok = "key is not null and term is not null and weight is not null"
    left, right = left.where(ok).select("key", "term", "weight"), right.where(ok).select("key", "term", "weight")
    per = left.select("term", "weight", F.lit(1).alias("side")).unionByName(right.select("term", "weight", F.lit(2).alias("side")))
    of = [F.when(F.col("side") == s, F.col("weight")) for s in (1, 2)]
    counts = [f(c).alias(f"{n}_{s}") for n, f in (("most", F.max), ("n", F.count)) for s, c in enumerate(of, 1)]
    # a term that only one side has takes part in no dot product
    terms = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *counts).where("most_1 is not null and most_2 is not null")
    terms = stored(terms.withColumn("tid", F.monotonically_increasing_id()))
    size = terms.agg(F.sum(F.col("n_1").cast("double") * F.col("n_2")).alias("met"), F.sum(F.col("n_1") + F.col("n_2")).alias("entries")).head()
    if size.met and size.met > meetings * size.entries:
        return _by_blocks(left, right, terms, threshold)
    one, two = stored(_postings(left, terms, "most_2", threshold, 1)), stored(_postings(right, terms, "most_1", threshold, 2))
    reach = F.col("w_1") * F.col("w_2") + F.least(F.col("norm_1") * F.col("norm_2"), "bound_1", "bound_2")
    met = salted_join(one, two, ["term"], rows=POSTINGS).where(reach >= threshold - SLACK).select("key_1", "key_2").distinct()
    return dot_products(met, left, right).where(F.col("cosine") >= threshold - SLACK)
