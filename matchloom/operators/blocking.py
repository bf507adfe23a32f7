"""Candidate pairs by thresholded TF-IDF cosine of word-bounded character trigrams, and how good they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, word_trigrams
from ..runtime import joined, spread, stored
from .cosine import SLACK, cosine_join, dot_products
from .gram_blocks import meet

def gram_counts(df: DataFrame, id_col: str, text_col: str, side: str) -> DataFrame:
    """``(side, id, gram, tf)`` of the normalised text; rows without text have no grams."""
    grams = spread(df.select(id_col, text_col)).select(F.lit(side).alias("side"), F.col(id_col).alias("id"), F.explode(word_trigrams(normalize(F.col(text_col)))).alias("gram"))
    return grams.groupBy("side", "id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(a: DataFrame, b: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``(side, id, gram, df, weight)``: unit vectors over the corpus of both tables with smooth inverse document frequency.

    The number of documents is a one-row aggregate joined in the plan, so nothing comes to the driver.
    """
    counts = gram_counts(a, id_col, text_col, "a").unionByName(gram_counts(b, id_col, text_col, "b"))
    n = a.select(F.lit(1).alias("x")).unionByName(b.select(F.lit(1).alias("x"))).agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = joined(counts, idf, "gram").select("side", "id", "gram", "df", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("side", "id")))
    return raw.select("side", "id", "gram", "df", (F.col("w") / norm).alias("weight"))


def _sides(vectors: DataFrame) -> list[DataFrame]:
    return [vectors.where(F.col("side") == s).select(F.col("id").alias("key"), F.col("gram").alias("term"), "weight") for s in "ab"]


def similarity_join(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(ltable_id, rtable_id, score)`` for every pair of an a-row and a b-row with cosine of at least ``threshold``.

    Exact (see ``cosine.cosine_join``).  Pairs without a common gram never count, whatever the threshold.
    """
    return cosine_join(*_sides(vectors), threshold).toDF("ltable_id", "rtable_id", "score")


def generate_candidates(a: DataFrame, b: DataFrame, threshold: float = 0.1, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """Candidate pairs with their score; empty where either table is."""
    met = meet(a, b, threshold, id_col, text_col)
    return similarity_join(stored(tfidf(a, b, id_col, text_col)), threshold) if met is None else met


def _ceiling(truth: DataFrame, found: DataFrame) -> DataFrame:
    hit = found.select("ltable_id", "rtable_id", F.lit(1).alias("hit")).distinct()
    counts = truth.join(hit, ["ltable_id", "rtable_id"], "left").agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("survived"))
    return counts.select("true_pairs", "survived", F.coalesce(F.col("survived") / F.nullif("true_pairs", F.lit(0)), F.lit(0.0)).alias("ceiling"))


def _truth(labels: DataFrame) -> DataFrame:
    return labels.where("label = 1").select("ltable_id", "rtable_id").distinct()


def recall_ceiling(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(true_pairs, survived, ceiling)``: distinct true pairs and those among the candidates; 0 without true pairs."""
    return _ceiling(_truth(labels), candidates)


def recall_ceiling_at(vectors: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The same for candidates at ``threshold`` without making them: the true pairs alone are scored, each once."""
    truth = _truth(labels)
    scored = dot_products(truth.toDF("key_1", "key_2"), *_sides(vectors)).where((F.col("cosine") > 0) & (F.col("cosine") >= threshold - SLACK))
    return _ceiling(truth, scored.toDF("ltable_id", "rtable_id", "score"))


def _reduction(counted: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    one = a.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_b"))).crossJoin(counted)
    full = F.col("n_a") * F.col("n_b")
    return one.select("n_a", "n_b", "candidates", F.when(full > 0, 1 - F.col("candidates") / full).otherwise(F.lit(0.0)).alias("reduction"))


def reduction(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(n_a, n_b, candidates, reduction)``: share of the full product that blocking spares."""
    return _reduction(candidates.agg(F.count(F.lit(1)).alias("candidates")), a, b)


def reduction_at(a: DataFrame, b: DataFrame, threshold: float, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """The same for candidates at ``threshold``, which are counted where they are found and not moved."""
    counted = meet(a, b, threshold, id_col, text_col, counted=True)
    return reduction(generate_candidates(a, b, threshold, id_col, text_col), a, b) if counted is None else _reduction(counted, a, b)
