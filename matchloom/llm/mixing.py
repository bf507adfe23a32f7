"""Mixing sources to target shares of all tokens by entropy balancing."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import spread, stored

#: Vocabulary file of the tokenizer that sizes are counted in; a parameter of every function below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of one source that are rounded together.
BUCKET = 20_000


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)``: the length of every whole text in tokens; 0 for null and empty texts."""

    held = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a file of bounded size, read where it is named

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held.value.splitlines() if line.strip())}
        encode = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for frame in frames:
            sizes = [len(encode(t)) if t else 0 for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "tokens": pd.Series(sizes, dtype="int64")})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(count, "doc_id long, source string, tokens long")


def balanced_rates(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, rounds: int = 60) -> tuple[DataFrame, dict[str, dict]]:
    """Rates of use ``(source, tokens, rate)`` for every size met in a wanted source, and the dual's solution by source.

    Of all rates between 0 and the source's cap that give each source its share of the largest feasible total, those
    with the least relative entropy to using everything once are exponentially tilted: ``min(cap, exp(tilt * tokens /
    mean))``.  The dual has one convex part per source; each round is one distributed aggregation that yields value and
    slope for all sources, followed by a Newton step kept inside a shrinking bracket.

    ``RuntimeError`` where a source is not balanced within ``tolerance`` after ``rounds``.

    Rates depend on source and size alone, so rows are counted by both first.  A wanted source without tokens cannot
    contribute; the shares of the others are scaled up to 1.
    """
    wanted = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None and r.target_share and r.target_share > 0 and r.max_repeats and r.max_repeats > 0]
    counted = stored(sizes.where("tokens > 0").join(targets.select("source").distinct(), "source", "left_semi").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r.source: r for r in counted.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("total"), (F.sum(F.col("n") * F.col("tokens")) / F.sum("n")).alias("mean"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).collect()}
    wanted = [r for r in wanted if r.source in have]
    shares = sum(r.target_share for r in wanted)
    total = min((r.max_repeats * have[r.source].total * shares / r.target_share for r in wanted), default=0.0)
    state = {}
    for r in wanted:
        goal, cap, h = total * r.target_share / shares, float(r.max_repeats), have[r.source]
        # below the lower end every rate is too small, at the upper end all are at the cap
        low = (math.log(goal / h.total) - 1) * h.mean / (h.least if goal < h.total else h.most) - 1
        high = math.log(cap) * h.mean / h.least + 1
        state[r.source] = {"goal": goal, "cap": cap, "mean": h.mean, "low": low, "high": high, "tilt": max(low, min(high, math.log(goal / h.total))), "done": False}
    spark = sizes.sparkSession
    schema = "source string, tilt double, cap double, mean double"

    def current() -> DataFrame:
        return spark.createDataFrame([(k, s["tilt"], s["cap"], s["mean"]) for k, s in state.items()], schema)

    rate = F.least("cap", F.exp(F.col("tilt") * F.col("tokens") / F.col("mean")))
    for _ in range(rounds):
        if all(s["done"] for s in state.values()):
            break
        tilted = counted.join(F.broadcast(current()), "source").withColumn("rate", rate)
        used = F.col("n") * F.col("tokens") * F.col("rate")
        sums = tilted.groupBy("source").agg(F.sum(used).alias("value"), F.sum(F.when(F.col("rate") < F.col("cap"), used * F.col("tokens") / F.col("mean")).otherwise(0.0)).alias("slope")).collect()
        for r in sums:
            s = state[r.source]
            gap = r.value - s["goal"]
            if abs(gap) <= tolerance * s["goal"]:
                s["done"] = True
                continue
            s["low" if gap < 0 else "high"] = s["tilt"]
            step = s["tilt"] - gap / r.slope if r.slope > 0 else math.inf
            s["tilt"] = step if s["low"] < step < s["high"] else (s["low"] + s["high"]) / 2
    if left := sorted(k for k, s in state.items() if not s["done"]):
        raise RuntimeError(f"no balance after {rounds} rounds for {', '.join(left)}")
    rates = counted.join(F.broadcast(current()), "source").select("source", "tokens", rate.alias("rate"))
    return rates, state


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, rate, copies)`` for every document that the mixture uses.

    Rates are rounded by carrying the remainder along in an order drawn from the ids, within buckets of bounded size, so
    copies add up to the rates and no document passes its source's cap.  Documents of unwanted or null source,
    and those without text, are not used; equal documents are treated each on its own.
    """
    return _copies(stored(token_sizes(documents, vocabulary)), targets)


def _copies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    rates, _ = balanced_rates(sizes, targets)
    rated = sizes.join(rates, ["source", "tokens"])
    buckets = sizes.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("buckets"))
    placed = rated.join(F.broadcast(buckets.join(targets.select("source").distinct(), "source", "left_semi")), "source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.col("buckets")))
    so_far = F.sum("rate").over(Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    carried = placed.withColumn("so_far", F.round(so_far, 6))
    copies = (F.floor(F.col("so_far") + 0.5) - F.floor(F.col("so_far") - F.round("rate", 6) + 0.5)).cast("int")
    return carried.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies")


def reached_shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, target_share, share, tokens, documents, most_copies)`` for every wanted source."""
    mixed = mixture(documents, targets, vocabulary)
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    joined = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    share = tokens / F.sum(tokens).over(Window.partitionBy())  # one row for each wanted source
    return joined.select("source", "target_share", F.coalesce(share, F.lit(0.0)).alias("share"), tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
