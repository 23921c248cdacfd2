"""Confusion metrics, sweep roll-ups and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.functions.quantiles import finite


def confusion(df: DataFrame, pred: Column, gt: Column, by: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn with IoU, precision, recall, F1 and foreground share; empty denominators count as 1."""
    n = lambda c: F.count_if(c).alias
    c = df.groupBy(*by).agg(n(pred & gt)("tp"), n(pred & ~gt)("fp"), n(~pred & gt)("fn"), n(~pred & ~gt)("tn"))
    one = lambda x: F.greatest(x, F.lit(1))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    c = c.withColumn("iou", tp / one(tp + fp + fn)).withColumn("precision", tp / one(tp + fp)).withColumn("recall", tp / one(tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))).withColumn("foreground", (tp + fp) / one(tp + fp + fn + tn))


def segmentation_metrics(df: DataFrame, pred: Column, gt: Column, by: Sequence[str]) -> DataFrame:
    """The same for segmentation: 1e-8 is added to the union, and divisions by zero give 0."""
    c = df.groupBy(*by).agg(F.count_if(pred & gt).alias("tp"), F.count_if(pred & ~gt).alias("fp"), F.count_if(~pred & gt).alias("fn"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return c.select(*by, (tp / (tp + fp + fn + F.lit(1e-8))).alias("iou"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def gap_recall(df: DataFrame, pred: Column, gt: Column, texture: Column, by: Sequence[str]) -> DataFrame:
    """Recall on what the texture mask misses of the truth; null where it misses nothing."""
    return df.groupBy(*by).agg((F.count_if(pred & gt & ~texture) / F.nullif(F.count_if(gt & ~texture), F.lit(0))).alias("gap_recall"))


def spatial_disagreement(df: DataFrame, mask: str, group: Sequence[str]) -> DataFrame:
    """(group, disagreement): how often neighbours in a row or a column differ, the mean of both axes."""
    d = df
    for axis, other in (("f", "t"), ("t", "f")):
        d = d.withColumn(f"_{axis}", (F.col(mask) != F.lead(mask).over(Window.partitionBy(*group, other).orderBy(axis))).cast("double"))
    return d.groupBy(*group).agg(((F.avg("_f") + F.avg("_t")) / 2).alias("disagreement"))


def sweep_summary(metrics: DataFrame, columns: Sequence[str], by: str = "snr_db") -> DataFrame:
    """Means for each level, highest level first."""
    return metrics.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("runs")).orderBy(F.col(by).desc())


def best_examples(metrics: DataFrame, score: str, order: Sequence[str], by: str = "snr_db") -> DataFrame:
    """The best row of each level; the first of equal ones."""
    return metrics.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), *order))).where("_r = 1").drop("_r")


def stage_fractions(df: DataFrame, stages: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, stage, fraction): the foreground share of each stage's mask."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(s).cast("double")).alias(s) for s in stages])
    return wide.unpivot(list(by), list(stages), "stage", "fraction")


def unlabelled_statistics(df: DataFrame, mask: Column, noise: Column, by: Sequence[str]) -> DataFrame:
    """Signal share and mean confidence inside the mask (0 where it is empty)."""
    return df.groupBy(*by).agg(F.avg(mask.cast("double")).alias("signal_fraction"), F.coalesce(F.avg(F.when(mask, 1 - noise)), F.lit(0.0)).alias("confidence"))


def false_alarm_curve(df: DataFrame, p: Column, noise: Column, thresholds: Sequence[float], target: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """False-alarm rate of noise rows at each threshold, and the chosen one: the largest that keeps the target, else 0.5."""
    cuts = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rates = df.where(noise).select(p.alias("_p")).crossJoin(F.broadcast(cuts)).groupBy("threshold").agg(F.avg((F.col("_p") >= F.col("threshold")).cast("double")).alias("fpr"))
    return rates, rates.agg(F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("threshold"))), F.lit(0.5)).alias("chosen"))


def safe_correlation(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by, correlation): null for fewer than two points or a side that does not vary."""
    a, b = finite(F.col(x)), finite(F.col(y))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    g = df.groupBy(*by).agg(F.count(a).alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.corr(a, b).alias("c"))
    return g.select(*by, F.when((F.col("n") >= 2) & (F.col("sa") >= 1e-8) & (F.col("sb") >= 1e-8), F.col("c")).alias("correlation"))


def roughness(df: DataFrame, column: str, axis: str, group: Sequence[str]) -> DataFrame:
    """(group, roughness): mean step along an axis over the spread; 0 where nothing varies."""
    other = "f" if axis == "t" else "t"
    step = F.abs(F.col(column) - F.lag(column).over(Window.partitionBy(*group, other).orderBy(axis)))
    g = df.withColumn("_s", step).groupBy(*group).agg(F.avg("_s").alias("s"), F.stddev_pop(column).alias("d"))
    return g.select(*group, F.when(F.col("d") < 1e-6, F.lit(0.0)).otherwise(F.col("s") / F.col("d")).alias("roughness"))


def boundary_energy(df: DataFrame, chunks: DataFrame, column: str, group: Sequence[str]) -> DataFrame:
    """(group, at_boundary, elsewhere): mean step along frequency at sub-band limits and away from them."""
    limits = chunks.select("capture_id", F.explode(F.array("row_start", "row_stop")).alias("_f")).distinct().withColumnRenamed("capture_id", "_c")
    step = F.abs(F.col(column) - F.lag(column).over(Window.partitionBy(*group, "t").orderBy("f")))
    d = df.withColumn("_s", step)
    d = d.join(limits, (d.capture_id == limits._c) & (d.f == limits._f), "left")
    at = F.col("_f").isNotNull()
    return d.groupBy(*group).agg(F.avg(F.when(at, F.col("_s"))).alias("at_boundary"), F.avg(F.when(~at, F.col("_s"))).alias("elsewhere"))


def positional_correlation(df: DataFrame, column: str, group: Sequence[str], r: str = "f", c: str = "t") -> DataFrame:
    """Correlation of a map with its row and column numbers."""
    return df.groupBy(*group).agg(F.corr(column, r).alias("row_correlation"), F.corr(column, c).alias("column_correlation"))


def sweep_checks(metrics: DataFrame, columns: Sequence[str], better: str, baseline: str, least: float = -0.08) -> DataFrame:
    """One row: no NaN, all values in 0..1, and the mean gain over the baseline above the least."""
    bad = F.lit(False)
    out = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.isnan(c), F.lit(False))
        out = out | ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))
    gain = F.avg(F.col(better) - F.col(baseline))
    return metrics.agg((F.count_if(bad) == 0).alias("no_nan"), (F.count_if(out) == 0).alias("in_range"), (gain > least).alias("gain_ok"))
