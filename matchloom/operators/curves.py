"""Quality of scores against labels: curves, thresholds and summary figures.

All take a frame with a label ``y`` (0 or 1) and a score ``s``.  Scores are counted by value first, so the ordered sums that have no
natural partition run over distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def by_score(scored: DataFrame) -> DataFrame:
    """``(s, pos, neg)`` for every distinct score."""
    return scored.groupBy("s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


#: Ranges of values that ordered sums are made in at once.
RANGES = 64


def running_sums(counted: DataFrame, value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``counted``, one row for each ``value``, with running and whole sums: ``{"n": "upto"}`` adds ``upto`` and ``all_n`` to column n.

    Values are cut into ranges of about equal numbers of rows, summed in each range at once, and what the ranges before it hold is
    added, so that no task orders all values.
    """
    edges = counted.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)]).alias("e")).head().e or []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>"), lambda e: e < F.col(value)))
    placed = counted.withColumn("_range", -place if descending else place)
    whole = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = whole.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"all_{c}") for c in sums])
    within = Window.partitionBy("_range").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "_range")
    return joined.withColumns({out: F.sum(c).over(within) + F.col(f"_before_{c}") for c, out in sums.items()}).drop("_range", *[f"_before_{c}" for c in sums])


def cumulative(scored: DataFrame) -> DataFrame:
    """``(s, pos, neg, tp, fp, all_pos, all_neg)``: what lies at or above each distinct score."""
    return running_sums(by_score(scored), "s", {"pos": "tp", "neg": "fp"}, descending=True)


def pr_curve(scored: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)``: one point for each distinct score, and the end point (1, 0) without threshold."""
    points = cumulative(scored).select(F.col("s").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"))
    end = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def max_f1(scored: DataFrame) -> DataFrame:
    """One row ``(threshold, f1)``: the lowest of the thresholds with the best F1."""
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos"))
    best = cumulative(scored).select("s", f1.alias("f1")).agg(F.max(F.struct("f1", (-F.col("s")).alias("n"))).alias("b"))
    return best.select((-F.col("b.n")).alias("threshold"), F.col("b.f1").alias("f1"))


def ranking(scored: DataFrame) -> DataFrame:
    """One row ``(auc_roc, average_precision)``; ties count half in the first, which is null unless both labels occur."""
    wins = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2))
    pairs = F.max("all_pos") * F.max("all_neg")
    precision = F.sum(ratio(F.col("pos"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))
    return cumulative(scored).agg(F.when(pairs > 0, wins / pairs).alias("auc_roc"), precision.alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row ``(auc_roc)``."""
    return ranking(scored).select("auc_roc")


def average_precision(scored: DataFrame) -> DataFrame:
    """One row ``(average_precision)``: precision at each score weighted by the recall it adds."""
    return ranking(scored).select("average_precision")


def confusion(decided: DataFrame) -> DataFrame:
    """One row ``(tn, fp, fn, tp)`` from label ``y`` and decision ``pred``."""
    return decided.agg(*[F.count_if((F.col("y") == y) & (F.col("pred") == p)).alias(n) for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def brier(scored: DataFrame) -> Column:
    """Aggregate: mean squared distance of the score, clipped to [0, 1], from the label."""
    return F.avg(F.pow(F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0)) - F.col("y"), 2))


def metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row with the ten figures of an evaluation at ``threshold``; ranking figures use the score as it is."""
    pred = (F.col("s") >= threshold).cast("int")
    base = scored.withColumn("pred", pred)
    tp, fp, fn = (F.count_if((F.col("y") == y) & (F.col("pred") == p)) for y, p in ((1, 1), (0, 1), (1, 0)))
    sums = base.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), brier(base).alias("brier_score"), F.count(F.lit(1)).alias("n_test"), F.sum(F.col("y").cast("long")).alias("n_positive"), F.sum(F.col("pred").cast("long")).alias("n_predicted_positive"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    joined = sums.crossJoin(ranking(scored))
    return joined.select(F.lit(float(threshold)).alias("threshold"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), "auc_roc", "average_precision", "brier_score", "n_test", "n_positive", "n_predicted_positive")


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, mean_score, mean_label, n)`` for each non-empty bin of equal width; a score on an edge belongs to the bin below."""
    clipped = F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0))
    index = sum(((clipped > i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    return scored.groupBy(index.alias("bin")).agg(F.avg(clipped).alias("mean_score"), F.avg("y").alias("mean_label"), F.count(F.lit(1)).alias("n"))


def class_weight(labelled: DataFrame) -> DataFrame:
    """One row ``(n_neg, n_pos, weight)``: negatives per positive, null without positives."""
    c = labelled.agg(F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos"))
    return c.select("n_neg", "n_pos", (F.col("n_neg") / F.nullif("n_pos", F.lit(0))).alias("weight"))


def isotonic(scored: DataFrame) -> DataFrame:
    """``(s, fitted)``: the best non-decreasing fit of the labels at every distinct score, by MLlib's pool-adjacent-violators."""
    from pyspark.ml.regression import IsotonicRegression

    points = by_score(scored).select(F.col("s").cast("double").alias("s"), (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("mean"), (F.col("pos") + F.col("neg")).cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="s", labelCol="mean", weightCol="w", predictionCol="fitted", isotonic=True).fit(points)
    return model.transform(points).select("s", F.least(F.greatest("fitted", F.lit(0.0)), F.lit(1.0)).alias("fitted"))
