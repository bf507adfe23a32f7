"""Profiles of tables and samples of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curves import running_sums


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, nulls, null_rate)`` per column, from one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("r")
    return counts.select("n", rows).select("r.column", "r.nulls", F.coalesce(F.col("r.nulls") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("null_rate"))


def quantiles(df: DataFrame, value: Column, at: dict[str, float]) -> DataFrame:
    """One row with the exact quantiles ``at``, interpolated between neighbours; null without values.

    Values are counted first and found by their ranks, so no task holds them all.
    """
    counted = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counted, "v", {"n": "upto"})

    def ranked_value(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    spot = {k: (F.col("all_n") - 1) * F.lit(q) for k, q in at.items()}
    ends = ranked.agg(*[f(ranked_value(g(c))).alias(f"{k}_{n}") for k, c in spot.items() for n, f, g in (("lo", lambda x: x, F.floor), ("hi", lambda x: x, F.ceil))], F.max("all_n").alias("all_n"))
    share = {k: c - F.floor(c) for k, c in spot.items()}
    return ends.select(*[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * share[k]).alias(k) for k in at])


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, exact interpolated quartiles, largest; nulls and NaN left out."""
    c = F.col(column).cast("double")
    sums = df.where(c.isNotNull() & ~F.isnan(c)).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return sums.crossJoin(quantiles(df, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75})).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def median_length(df: DataFrame, column: str) -> DataFrame:
    """One row ``(median_length)`` of a text column; nulls left out."""
    return quantiles(df, F.length(column).cast("double"), {"median_length": 0.5})


def first_per_class(df: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of every value of ``by`` in the given order; Spark keeps ``n`` of each task before they meet."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def look_up(df: DataFrame, id_col: str, *ids: int) -> DataFrame:
    """The records with these ids."""
    return df.where(F.col(id_col).isin(*ids))


def label_mix(splits: dict[str, DataFrame]) -> DataFrame:
    """``(split, positives, total, share)`` for labelled splits; rows without label count in the total only."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("split"), "label") for k, df in splits.items()])
    pos = F.count_if(F.col("label") == 1)
    return every.groupBy("split").agg(pos.alias("positives"), F.count(F.lit(1)).alias("total"), (pos / F.count(F.lit(1))).alias("share"))


def histogram(df: DataFrame, column: str, bins: int, clip: float | None = None, by: str | None = None) -> DataFrame:
    """``([by,] bin, low, n, density)``: equal-width bins over the column's range, the last one closed above.

    Values above ``clip`` count as ``clip``; nulls and NaN are left out.  The range is a one-row aggregate in the plan.
    """
    c = F.col(column).cast("double")
    keys = [by] if by else []
    value = F.least(c, F.lit(clip)) if clip is not None else c
    v = df.where(c.isNotNull() & ~F.isnan(c)).select(*keys, value.alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    placed = v.crossJoin(F.broadcast(ends)).select(*keys, width.alias("w"), "lo", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counted = placed.groupBy(*keys, "bin", "lo", "w").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counted.select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), "n", (F.col("n") / (total * F.col("w"))).alias("density"))


def top_k(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The ``k`` largest rows; ``ties`` decide between equal ones."""
    return df.orderBy(by.desc(), *ties).limit(k)


def error_samples(decided: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The first ``k`` false positives and false negatives in the order of ``key``, with ``kind`` fp or fn."""
    kind = F.when((F.col("pred") == 1) & (F.col("y") == 0), "fp").when((F.col("pred") == 0) & (F.col("y") == 1), "fn")
    wrong = decided.withColumn("kind", kind).where("kind is not null")
    parts = [wrong.where(F.col("kind") == n).orderBy(key).limit(k) for n in ("fp", "fn")]
    return parts[0].unionByName(parts[1])


def metric_table(results: dict[str, dict[str, float]], spark) -> DataFrame:
    """``(metric, <name>...)``: rounded figures side by side, one row for each metric."""
    names = sorted({k for r in results.values() for k in r})
    rows = [(n.replace("_", " ").title(), *[round(float(r[n]), 3) if isinstance(r.get(n), int | float) else None for r in results.values()]) for n in names]
    return spark.createDataFrame(rows, "metric string, " + ", ".join(f"`{k}` double" for k in results))
