"""Accuracy metrics, histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import clip, rounded


def counts(pred: Column, truth: Column) -> list[Column]:
    """tp, fp, fn, tn as aggregates; rows whose truth is neither 0 nor 1 count nowhere."""
    p, g, ok = F.coalesce(pred, F.lit(False)), truth == 1, truth.isin(0, 1)
    return [F.count_if(ok & p & g).alias("tp"), F.count_if(ok & p & ~g).alias("fp"), F.count_if(ok & ~p & g).alias("fn"), F.count_if(ok & ~p & ~g).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def scores(df: DataFrame) -> DataFrame:
    """Adds IoU, F1, precision, recall, specificity, accuracy and kappa to rows with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po = _ratio(tp + tn, n)
    pe = _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    out = {"iou": _ratio(tp, tp + fp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "accuracy": po, "kappa": F.when((n > 0) & (1 - pe > 0), (po - pe) / (1 - pe)).otherwise(0.0)}
    return df.select("*", *(rounded(v, 4).alias(k) for k, v in out.items()))


def confusion_class(pred: Column, truth: Column) -> Column:
    """0 true negative, 1 true positive, 2 false positive, 3 false negative."""
    return F.when(pred & (truth == 1), 1).when(pred, 2).when(truth == 1, 3).otherwise(0)


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, count and density of equal bins, the last one closed; empty bins too. Values outside count nowhere."""
    step = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("int")
    have = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(have), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))  # a row per bin
    return full.withColumn("total", F.sum("count").over(Window.partitionBy())).select("bin", "count", rounded(F.when(F.col("total") > 0, F.col("count") / F.col("total") / step).otherwise(0.0), 8).alias("density"))


def otsu(df: DataFrame, value: str, bins: int = 256, low: float | None = None, high: float | None = None) -> DataFrame:
    """The threshold between two modes, by the between-class variance over a histogram of min..max; optionally clipped.

    As in the reference's own results, the upper mean divides the suffix sum including a bin by the mass above it. The
    histogram is aggregated first; the running sums then see one row per bin."""
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    binned = v.crossJoin(F.broadcast(ends)).select("lo", "hi", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin"))  # ends: one row
    have = binned.groupBy("lo", "hi", "bin").agg(F.count("*").alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    h = every.join(F.broadcast(have.select("bin", "c")), "bin", "left").select("bin", (F.col("lo") + step * (F.col("bin") + 0.5)).alias("center"), F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    up, down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("w1", F.sum("c").over(up)).withColumn("total", F.sum("c").over(Window.partitionBy())).withColumn("w2", F.col("total") - F.col("w1"))
    h = h.withColumn("m1", F.sum(F.col("c") * F.col("center")).over(up) / (F.col("w1") + 1e-9)).withColumn("m2", F.sum(F.col("c") * F.col("center")).over(down) / (F.col("w2") + 1e-9))
    nxt = Window.orderBy("bin")
    h = h.withColumn("variance", F.col("w1") * F.lead("w2").over(nxt) * F.pow(F.col("m1") - F.lead("m2").over(nxt), 2.0)).where("variance IS NOT NULL")
    best = h.agg(F.max_by("center", F.struct(F.col("variance"), -F.col("bin"))).alias("t"))
    return best.select(F.col("t").alias("threshold")) if low is None else best.select(clip(F.col("t"), low, high).alias("threshold"))
