"""Candidates for records that arrive as a stream, against a fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, word_trigrams
from ..operators.cosine import SLACK


def freeze_index(reference: DataFrame, id_col: str = "id", text_col: str = "title") -> tuple[DataFrame, DataFrame]:
    """``(postings, idf)`` of a reference table, written once and joined by every micro-batch."""
    grams = reference.select(F.col(id_col).alias("id"), F.explode(word_trigrams(normalize(F.col(text_col)))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    n = reference.agg(F.count(F.lit(1)).alias("n"))
    idf = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = grams.join(idf, "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("weight")), idf


def score_batch(records: DataFrame, postings: DataFrame, idf: DataFrame, threshold: float, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``(new_id, ref_id, score)`` of one micro-batch; grams unknown to the reference only lengthen the new record's vector."""
    grams = records.select(F.col(id_col).alias("new_id"), F.explode(word_trigrams(normalize(F.col(text_col)))).alias("gram")).groupBy("new_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    rarest = idf.agg(F.max("idf").alias("top"))
    weighed = grams.join(idf, "gram", "left").crossJoin(F.broadcast(rarest)).select("new_id", "gram", (F.col("tf") * F.coalesce("idf", "top", F.lit(1.0))).alias("w"))
    norms = weighed.groupBy("new_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    new = weighed.join(norms, "new_id").select("new_id", "gram", (F.col("w") / F.col("norm")).alias("v"))
    met = new.join(postings, "gram").groupBy("new_id", F.col("id").alias("ref_id")).agg(F.sum(F.col("v") * F.col("weight")).alias("score"))
    return met.where(F.col("score") >= threshold - SLACK)


def score_stream(stream: DataFrame, postings: DataFrame, idf: DataFrame, threshold: float, sink: str, checkpoint: str):
    """Start scoring a stream; each micro-batch is written under its number, so a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch, postings, idf, threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
