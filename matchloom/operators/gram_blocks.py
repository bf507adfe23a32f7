"""Meeting of two tables' texts by TF-IDF cosine: texts are moved and stored, their trigrams exist only within a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, word_trigrams
from ..runtime import dropped, parallel, spread, stored
from . import cosine as K

#: Between the texts of a block; normalised texts have no white space but single spaces.
END = 10


def texts(sides: dict[str, DataFrame], id_col: str, text_col: str, blocks: dict[str, int]) -> DataFrame:
    """``(side, b, id, text)``: one normalised text for each id, those of equal ids put together, and its block; rows without words are left out.

    Trigrams do not go beyond a word, so those of texts put together are those of the parts.
    """
    each = []
    for side, df in sides.items():
        words = spread(df.select(id_col, text_col)).select(F.lit(side).alias("side"), F.col(id_col).alias("id"), normalize(F.col(text_col)).alias("text")).where("text <> ''")
        each.append(words.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks[side])).cast("int")))
    every = each[0].unionByName(each[1])
    placed = every.repartition(parallel(every.sparkSession), "side", "b")
    return placed.groupBy("side", "b", "id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))


def grams_of(texts_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(side, b, gram, n)``, the texts of a block that have the gram, and ``(gram, df, n_a, n_b)``, those of the corpus and of its sides."""
    by_block = stored(texts_.select("side", "b", F.explode(F.array_distinct(word_trigrams(F.col("text")))).alias("gram")).groupBy("side", "b", "gram").agg(F.count(F.lit(1)).alias("n")))
    of = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in "ab"]
    return by_block, stored(by_block.groupBy("gram").agg(F.sum("n").alias("df"), *of))


def codes(points: np.ndarray) -> np.ndarray:
    """A number for each three code points."""
    return points[..., 0] << 42 | points[..., 1] << 21 | points[..., 2]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _packed(n: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A block as one row ``(side, block)``: its ids and texts, and its grams with what they weigh."""

    def pack(rows: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"side": [], "block": []})
        code = codes(_points("".join(grams["gram"])).reshape(-1, 3))
        order = np.argsort(code)
        df = grams["df"].to_numpy()[order]
        arrays = {
            "keys": rows["id"].to_numpy(), "text": "\n" + "\n".join(rows["text"]) + "\n", "terms": code[order], "df": df,
            "idf": np.log((1 + n) / (1 + df)) + 1, "shared": grams["shared"].to_numpy(bool)[order],
        }
        return pd.DataFrame({"side": rows["side"].iloc[:1].to_list(), "block": [pickle.dumps(arrays, protocol=5)]})

    return pack


def vectors(block: bytes) -> dict:
    """The block's unit vectors one after the other, each from its most to its least frequent gram; grams that only one side has only count in the norm."""
    given = pickle.loads(block)
    points = _points(given["text"])
    ends = points == END
    points[ends] = 32
    at = np.flatnonzero(points != 32)
    size = len(given["terms"])
    order = np.lexsort((given["terms"], -given["df"]))
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    code = codes(np.stack([points[at - 1], points[at], points[at + 1]], axis=-1))
    doc = np.cumsum(ends)[at] - 1
    both, tf = np.unique(doc * size + rank[np.searchsorted(given["terms"], code)], return_counts=True)
    doc, code = both // size, order[both % size]
    weight = tf * given["idf"][code]
    weight /= np.sqrt(np.bincount(doc, weight * weight, len(given["keys"])))[doc]
    kept = given["shared"][code]
    doc, code, weight = doc[kept], code[kept], weight[kept]
    names, starts = np.unique(doc, return_index=True)
    return {"keys": given["keys"][names], "bounds": np.append(starts, len(doc)), "terms": given["terms"], "code": code, "weight": weight}


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums from the start of each range up to every value."""
    total = np.cumsum(values)
    starts = bounds[:-1]
    return total - np.repeat(total[starts] - values[starts], np.diff(bounds))


def indexed(left: dict, right: dict, threshold: float) -> dict:
    """``right`` with ``open``, whether an entry is indexed, and ``rest``, what each vector's other entries can add at most to a dot product with a vector of ``left``."""
    if not len(right["keys"]):
        return right | {"open": np.zeros(0, bool), "rest": np.zeros(0)}
    place = np.searchsorted(right["terms"], left["terms"])
    place[place == len(right["terms"])] = 0
    known = (right["terms"][place] == left["terms"])[left["code"]]
    most = np.zeros(len(right["terms"]))
    np.maximum.at(most, place[left["code"]][known], left["weight"][known])
    reach = np.minimum(np.sqrt(_summed(right["weight"] ** 2, right["bounds"])), _summed(right["weight"] * most[right["code"]], right["bounds"]))
    open_ = reach > K.UNINDEXED * threshold
    return right | {"open": open_, "rest": np.maximum.reduceat(np.where(open_, 0.0, reach), right["bounds"][:-1])}


def _meetings(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[Iterator[tuple]]:
    """The pairs of each two blocks; a block that stands in several rows on end is read once."""
    last: tuple = (None, None)
    for given in batches:
        for one, two in zip(given.column("one"), given.column("two"), strict=True):
            one, two = one.as_buffer(), two.as_buffer()
            if last[0] is None or not last[0].equals(one):
                last = one, vectors(one)
            left = last[1]
            yield K.block_pairs(left, indexed(left, vectors(two), threshold), threshold)


def _pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _meetings(batches, threshold):
            yield from K.batched(found)

    return meet


def _numbers(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _meetings(batches, threshold):
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(dots) for _, _, dots in found)], pa.int64())], ["n"])

    return count


def meet(a: DataFrame, b: DataFrame, threshold: float, id_col: str, text_col: str, counted: bool = False, meetings: float = K.MEETINGS) -> DataFrame | None:
    """``(ltable_id, rtable_id, score)`` of the pairs that ``cosine.cosine_join`` gives for the vectors of both tables, or with ``counted`` their number ``n``.

    ``None`` where the texts meet in so few common grams that joining their entries is less work.  What is shuffled and
    stored are texts, and a row for each gram of a block; pairs that are only counted leave no task.
    """
    spark, sides = a.sparkSession, {"a": a, "b": b}
    n = {s: df.count() for s, df in sides.items()}
    blocks = {s: max(1, -(-k // K.BLOCK)) for s, k in n.items()}
    blocks["a"] = max(blocks["a"], -(-parallel(spark) // blocks["b"]))
    # rows without id are one more text of the corpus, but in no pair
    every = stored(texts(sides, id_col, text_col, blocks))
    by_block, terms = grams_of(every)
    size = terms.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("met"), F.sum(F.when(F.col("n_a") * F.col("n_b") > 0, F.col("df"))).alias("entries")).head()
    if not size.met or size.met <= meetings * size.entries:
        for table in (every, by_block, terms):
            dropped(table)
        return None
    weighed = by_block.join(terms.select("gram", "df", (F.least("n_a", "n_b") > 0).alias("shared")), "gram").select("side", "b", "gram", "df", "shared")
    packed = stored(every.where("id is not null").groupBy("side", "b").cogroup(weighed.groupBy("side", "b")).applyInPandas(_packed(sum(n.values())), "side string, block binary"))
    for table in (every, by_block, terms):
        dropped(table)
    one, two = (packed.where(F.col("side") == s).select(F.col("block").alias(x)) for s, x in (("a", "one"), ("b", "two")))
    # a left block for each task, which a row of the product holds with one of the right
    met = one.repartition(blocks["a"]).crossJoin(two.hint("shuffle_replicate_nl"))
    if counted:
        return met.mapInArrow(_numbers(threshold), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    kind = every.schema["id"].dataType.simpleString()
    return met.mapInArrow(_pairs(threshold), f"key_1 {kind}, key_2 {kind}, cosine double").toDF("ltable_id", "rtable_id", "score")
