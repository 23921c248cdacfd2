"""Quantile thresholds and normalisers over groups of rows.

Quantiles are exact, with linear interpolation, over finite values. Each function aggregates once and joins the few
scalars back on the group. Groups without finite values get the stated defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.sources.tables import stored

GROUP = ("capture_id", "frame_id")


def finite(x: Column) -> Column:
    """The value, or null where it is not finite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def with_scalars(df: DataFrame, group: Sequence[str], **scalars: Column) -> DataFrame:
    """df with aggregates of its group as columns."""
    found = df.groupBy(*group).agg(*[e.alias(n) for n, e in scalars.items()])
    found = found.select(*[F.col(g).alias(f"_{g}") for g in group], *scalars)
    on = [df[g].eqNullSafe(F.col(f"_{g}")) for g in group]
    out = df.join(found, on[0] if len(on) == 1 else _all(on), "left") if group else df.crossJoin(F.broadcast(found))
    return out.drop(*[f"_{g}" for g in group])


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def unit(x: Column, low: Column, high: Column) -> Column:
    """x between low and high as 0..1, clipped; a span of nothing becomes 1e-6. Without bounds 0."""
    top = F.when(high <= low, low + 1e-6).otherwise(high)
    return F.when(low.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (top - low))))


def normalize_local(df: DataFrame, column: str, out: str, low: float = 0.05, high: float = 0.95, group: Sequence[str] = GROUP) -> DataFrame:
    """The column scaled to 0..1 between two quantiles of its group."""
    d = with_scalars(df, group, _q=F.percentile(finite(F.col(column)), F.array(F.lit(low), F.lit(high))))
    return d.withColumn(out, unit(F.coalesce(finite(F.col(column)), F.col("_q")[0]), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def normalize_masked(df: DataFrame, column: str, mask: Column, out: str, low: float = 0.05, high: float = 0.95, group: Sequence[str] = GROUP, keep_bounds: bool = False) -> DataFrame:
    """normalize_local with quantiles inside the mask, and 0 outside it."""
    d = with_scalars(df.withColumn("_m", mask), group, _q=F.percentile(F.when(F.col("_m"), finite(F.col(column))), F.array(F.lit(low), F.lit(high))))
    d = d.withColumn(out, F.when(F.col("_m"), unit(F.coalesce(finite(F.col(column)), F.col("_q")[0]), F.col("_q")[0], F.col("_q")[1])).otherwise(F.lit(0.0)))
    if keep_bounds:
        d = d.withColumn("low_value", F.col("_q")[0]).withColumn("high_value", F.col("_q")[1])
    return d.drop("_q", "_m")


def normalize_vector(df: DataFrame, column: str, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Scaled between smallest and largest; a constant group becomes all ones."""
    w = Window.partitionBy(*group)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(hi <= lo + 1e-8, F.lit(1.0)).otherwise((F.col(column) - lo) / (hi - lo)))


def minmax(df: DataFrame, column: str, out: str, group: Sequence[str] = GROUP, eps: float = 1e-8) -> DataFrame:
    w = Window.partitionBy(*group)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, (F.col(column) - lo) / (hi - lo + eps))


def zscore(df: DataFrame, column: str, out: str, group: Sequence[str] = GROUP, eps: float = 1e-8) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn(out, (F.col(column) - F.avg(column).over(w)) / (F.stddev_pop(column).over(w) + eps))


def robust_threshold(df: DataFrame, column: str, q: float, mask: Column | None = None, saturation: float = 0.9995, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, threshold): a high quantile; where it saturates, that of the values below saturation at q or 0.90 if less."""
    q = min(max(q, 0.50), 0.99)
    x = finite(F.col(column))
    x = x if mask is None else F.when(mask, x)
    found = df.groupBy(*group).agg(F.percentile(x, F.lit(q)).alias("_q"), F.percentile(F.when(x < saturation, x), F.lit(min(q, 0.90))).alias("_u"))
    value = F.when(F.col("_q").isNull(), F.lit(1.0)).when(F.col("_q") >= saturation, F.coalesce("_u", F.lit(saturation))).otherwise(F.col("_q"))
    return found.select(*group, value.alias("threshold"))


def above_quantile(df: DataFrame, column: str, out: str, q: float = 0.90, group: Sequence[str] = GROUP) -> DataFrame:
    """Whether a value reaches the group's quantile."""
    d = with_scalars(df, group, _q=F.percentile(finite(F.col(column)), F.lit(q)))
    return d.withColumn(out, F.coalesce(F.col(column) >= F.col("_q"), F.lit(False))).drop("_q")


def varying_quantile(df: DataFrame, column: str, fraction: Column, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, threshold) at a quantile that each group sets for itself: rank, then interpolate between two neighbours."""
    d = df.withColumn("_x", finite(F.col(column))).where("_x is not null")
    w = Window.partitionBy(*group)
    d = d.withColumn("_at", (F.count("*").over(w) - 1) * fraction).withColumn("_r", F.row_number().over(w.orderBy("_x")) - 1)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_r") - F.col("_at")))
    return d.groupBy(*group).agg(F.sum(F.col("_x") * weight).alias("threshold"))


def threshold_like(df: DataFrame, column: str, reference: Column, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """A mask with as large a share as the reference mask has (between 2 % and 60 %)."""
    d = with_scalars(df.withColumn("_ref", reference.cast("double")), group, _fg=F.greatest(F.lit(0.02), F.least(F.lit(0.60), F.avg("_ref"))))
    cuts = varying_quantile(d, column, 1 - F.col("_fg"), group).select(*[F.col(g).alias(f"_{g}") for g in group], "threshold")
    return d.join(cuts, _all([d[g].eqNullSafe(F.col(f"_{g}")) for g in group])).withColumn(out, F.col(column) >= F.col("threshold")).drop("_ref", "_fg", *[f"_{g}" for g in group])


def fixed_db_window(df: DataFrame, column: str = "power_db", low: float = 0.01, high: float = 0.99, min_span: float = 12.0, floor: float = -140.0, ceiling: float = -20.0, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, db_low, db_high): two quantiles, clipped, widened to the least span and moved back inside the limits."""
    q = df.groupBy(*group).agg(F.percentile(finite(F.col(column)), F.array(F.lit(low), F.lit(high))).alias("q"))
    lo, hi = (F.least(F.greatest(F.col("q")[i], F.lit(floor)), F.lit(ceiling)) for i in (0, 1))
    q = q.withColumn("lo", lo).withColumn("hi", hi)
    wide = F.col("hi") - F.col("lo") >= min_span
    mid = (F.col("lo") + F.col("hi")) / 2
    start = F.least(F.greatest(mid - min_span / 2, F.lit(floor)), F.lit(ceiling - min_span))
    none = F.col("q").isNull() | F.col("q")[0].isNull()
    return q.select(*group, F.when(none, F.lit(-110.0)).when(wide, F.col("lo")).otherwise(start).alias("db_low"), F.when(none, F.lit(-98.0)).when(wide, F.col("hi")).otherwise(start + min_span).alias("db_high"))


def noise_floor_db(df: DataFrame, column: str = "power_db", q: float = 0.20, trim: float = 0.80, least: int = 32, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, noise_floor_db): a quantile of the values up to the trim quantile; of all where fewer than `least` are left."""
    d = with_scalars(df.withColumn("_x", finite(F.col(column))), group, _cut=F.percentile("_x", F.lit(trim)))
    kept = F.when(F.col("_x") <= F.col("_cut"), F.col("_x"))
    found = d.groupBy(*group).agg(F.percentile(kept, F.lit(q)).alias("a"), F.count(kept).alias("n"), F.percentile("_x", F.lit(q)).alias("b"))
    value = F.coalesce(F.when(F.col("n") >= least, F.col("a")).otherwise(F.col("b")), F.lit(-100.0))
    return found.select(*group, F.least(F.greatest(value, F.lit(-140.0)), F.lit(-20.0)).alias("noise_floor_db"))


def signed_to_unit(df: DataFrame, column: str, out: str, q: float = 0.95, group: Sequence[str] = GROUP) -> DataFrame:
    """A signed value around 0.5, scaled by a quantile of its size."""
    d = with_scalars(df, group, _s=F.percentile(F.abs(finite(F.col(column))), F.lit(q)))
    scale = F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(1e-6))
    return d.withColumn(out, F.least(F.greatest(0.5 + 0.5 * F.col(column) / scale, F.lit(0.0)), F.lit(1.0))).drop("_s")


def top_mean(df: DataFrame, column: str, share: float = 0.02, least: int = 4, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, top_mean): the mean of the largest share of values, of `least` of them at the least."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_n", F.count(column).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(column).desc_nulls_last())))
    return d.where(F.col("_r") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share))).groupBy(*group).agg(F.avg(column).alias("top_mean"))


def sparse_evidence(df: DataFrame, strict: str, support: Column, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, q50, q85, q97, top_mean, support_fraction, weight): how much a few high scores stand out of the supported rows.

    All rows count as supported where none is. The weight is .60 of the 97 % quantile's rise over the 85 % one and .40 of the
    top mean's, in units of .12, held back where less than 3 % is supported; 0 without finite scores, .05 at the least.
    """
    d = df.withColumn("_sup", support).withColumn("_x", finite(F.col(strict)))
    d = with_scalars(d, group, _any=F.max("_sup"), _share=F.avg(F.col("_sup").cast("double"))).where("_sup or not _any")
    q = d.groupBy(*group).agg(F.percentile("_x", F.array(F.lit(0.50), F.lit(0.85), F.lit(0.97))).alias("q"), F.max(F.when(F.col("_any"), F.col("_share")).otherwise(F.lit(1.0))).alias("_f"), F.count("_x").alias("_n"))
    top = top_mean(d.where("_x is not null"), "_x", group=group).select(*[F.col(g).alias(f"_{g}") for g in group], "top_mean")
    j = q.join(top, _all([q[g].eqNullSafe(F.col(f"_{g}")) for g in group]), "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    j = j.select(*group, *[zero(F.col("q")[i]).alias(n) for i, n in enumerate(("q50", "q85", "q97"))], zero(F.col("top_mean")).alias("top_mean"), F.when(F.col("_n") > 0, F.col("_f")).otherwise(F.lit(0.0)).alias("support_fraction"), "_n")
    rise = 0.60 * F.greatest(F.col("q97") - F.col("q85"), F.lit(0.0)) + 0.40 * F.greatest(F.col("top_mean") - F.col("q85"), F.lit(0.0))
    weight = F.least(rise / 0.12, F.lit(1.0)) * (0.25 + 0.75 * F.least(F.sqrt(F.col("support_fraction") / 0.03), F.lit(1.0)))
    return j.withColumn("weight", F.when(F.col("_n") > 0, F.greatest(weight, F.lit(0.05))).otherwise(F.lit(0.0))).drop("_n")


def top_groups(df: DataFrame, column: str, key: str, k: int, group: Sequence[str] = GROUP) -> DataFrame:
    """The k keys of each group with the largest mean."""
    means = df.groupBy(*group, key).agg(F.avg(column).alias("mean_score"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("mean_score").desc(), key))).where(F.col("rank") <= max(1, k))


def select_components(df: DataFrame, score: str = "score", share: str = "share", max_clusters: int = 3, group: Sequence[str] = GROUP) -> DataFrame:
    """Of each group's components those near the best; very large ones only where they are about the best; never none."""
    w = Window.partitionBy(*group)
    best = F.max(score).over(w)
    d = df.withColumn("_best", best).withColumn("_ok", (F.col(score) >= F.greatest(F.lit(0.35), 0.72 * F.col("_best"))) & ((F.col(share) <= 0.45) | (F.col(score) >= 0.95 * F.col("_best"))))
    order = w.orderBy(F.col("_ok").desc(), F.col(score).desc(), "component")
    d = d.withColumn("_r", F.row_number().over(order))
    return d.where((F.col("_ok") & (F.col("_r") <= max_clusters)) | (F.col("_r") == 1)).drop("_best", "_ok", "_r")


def narrowed_quantiles(df: DataFrame, column: str, qs: Sequence[float], group: Sequence[str] = GROUP, bins: int = 1024, few: int = 10_000) -> DataFrame:
    """(group, quantiles): percentile(column, array(qs)) over finite values, for groups whose values no task can hold.

    The values at the ranks that a quantile lies between are found by counts: the range that holds a rank is cut into bins,
    the bin that holds it becomes the range, until it holds one value or `few` rows, which are then put in order. A round
    is one partial aggregation; all groups and ranks go together. Ties and repeated values end a range at once.
    """
    keys = list(group)
    # stored, as every round must meet the same values: a sum of doubles made again can differ in its last bits
    x = stored(df.select(*keys, finite(F.col(column)).cast("double").alias("x")).where("x is not null"), "quantiles-values")
    named = [F.col(k).alias(f"_{k}") for k in keys]
    same = lambda a: _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in a])
    ends = x.groupBy(*keys).agg(F.count("*").alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("inside") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(qs)])
    asked = stored(ends.withColumn("_q", F.explode(wanted)).select(*keys, "inside", "lo", "hi", "_q.i", "_q.at"), "quantiles-asked")
    ranks = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).select(*keys, "rank", F.col("rank").alias("left"), "inside", "lo", "hi").distinct()
    open_ = (F.col("hi") > F.col("lo")) & (F.col("inside") > few)
    ranks = stored(ranks, "quantiles-ranks")
    while not ranks.where(open_).isEmpty():
        within = x.join(ranks.where(open_).select(*named, "rank", "left", "lo", "hi"), same(keys) & F.col("x").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
        counts = within.groupBy(*keys, "rank", "left", place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        below = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin")) - F.col("n")
        hit = counts.withColumn("below", below).where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col("n")))
        ranks = stored(ranks.where(~open_).unionByName(hit.select(*keys, "rank", (F.col("left") - F.col("below")).alias("left"), F.col("n").alias("inside"), "lo", "hi")), "quantiles-ranks")
    some = x.join(ranks.where("hi > lo").select(*named, "rank", "left", "lo", "hi"), same(keys) & F.col("x").between(F.col("lo"), F.col("hi")))
    nth = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("x")) - 1).where(F.col("_n") == F.col("left")).select(*keys, "rank", F.col("x").alias("value"))
    values = stored(nth.unionByName(ranks.where("hi = lo").select(*keys, "rank", F.col("lo").alias("value"))), "quantiles-found")
    found = values.select(*named, F.col("rank").alias("_rank"), "value")
    j = asked.join(found, same(keys) & (F.col("_rank") >= F.floor("at")) & (F.col("_rank") <= F.ceil("at")))
    weight = F.when(F.ceil("at") == F.floor("at"), F.lit(1.0)).otherwise(1 - F.abs(F.col("_rank") - F.col("at")))
    return j.groupBy(*keys, "i").agg(F.sum(F.col("value") * weight).alias("v")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("quantiles"))
