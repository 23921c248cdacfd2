"""Neighbourhood operators on dense grids of (f, t) cells, written with window frames and small joins.

A grid is dense: each group has every (f, t) once. `axis` is "f" or "t". Edges repeat their value unless stated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.functions.quantiles import GROUP, normalize_local, signed_to_unit, with_scalars
from skywave.functions.scalars import from_db, relative_db
from skywave.sources.tables import stored


def _line(axis: str, group: Sequence[str]):
    return Window.partitionBy(*group, "f" if axis == "t" else "t").orderBy(axis)


def box_sum(df: DataFrame, column: str, out: str, axis: str, half: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Sum over 2 * half + 1 cells of an axis, edge values repeated for the missing ones."""
    line = _line(axis, group)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(column).cast("double")
    at = F.row_number().over(line) - 1
    n = F.count(F.lit(1)).over(whole)
    inside = F.sum(x).over(line.rowsBetween(-half, half))
    before, after = F.greatest(F.lit(0), half - at), F.greatest(F.lit(0), half - (n - 1 - at))
    return df.withColumn(out, inside + before * F.first(x).over(whole) + after * F.last(x).over(whole))


def box_mean(df: DataFrame, column: str, out: str, size_f: int, size_t: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Mean over an odd box, one axis after the other."""
    d, at = df, column
    for axis, size in (("f", size_f), ("t", size_t)):
        if size > 1:
            d = box_sum(d, at, out, axis, size // 2, group).withColumn(out, F.col(out) / size)
            at = out
    return d if at == out else d.withColumn(out, F.col(column).cast("double"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) up to four standard deviations; the weights sum to 1."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [(d, x / sum(w)) for d, x in zip(range(-radius, radius + 1), w, strict=True)]


def convolve_axis(df: DataFrame, column: str, out: str, axis: str, kernel: Sequence[tuple[int, float]], mode: str = "nearest", group: Sequence[str] = GROUP, line_key: Sequence[str] | None = None) -> DataFrame:
    """Weighted sum along an axis numbered 0..n-1; beyond the ends the value repeats (nearest) or mirrors (mirror: the edge
    itself is doubled). A line of the grid is one array, so a convolution costs one shuffle."""
    keys = [*group, *(line_key if line_key is not None else (["t"] if axis == "f" else ["f"]))]
    rest = [c for c in df.columns if c not in keys and c not in (out, axis)]
    source = df if column != out else df.withColumnRenamed(out, "_source")
    column = "_source" if column == out else column
    rest = [c if c != out else "_source" for c in rest] + (["_source"] if column == "_source" else [])
    lines = source.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(axis, *rest))).alias("_line")).withColumn("_n", F.size("_line"))
    lines = lines.withColumn("_x", F.transform("_line", lambda r: r[column].cast("double")))
    weights = F.array(*[F.struct(F.lit(int(d)).alias("d"), F.lit(float(w)).alias("w")) for d, w in kernel])
    n = F.col("_n")

    def at(i):
        if mode == "nearest":
            return F.least(F.greatest(i, F.lit(0)), n - 1)
        turn = F.pmod(i, 2 * n)
        return F.when(turn < n, turn).otherwise(2 * n - 1 - turn)

    def cell(r, i):
        value = F.aggregate(weights, F.lit(0.0), lambda total, k: total + k["w"] * F.get(F.col("_x"), at(i + k["d"])))
        return F.struct(r[axis].alias(axis), *[r[c].alias(c) for c in rest], value.alias(out))

    return lines.select(*keys, F.inline(F.transform("_line", cell))).drop("_source")


def majority_votes(df: DataFrame, mask: str, out: str, iterations: int = 2, group: Sequence[str] = GROUP) -> DataFrame:
    """A mask smoothed by the majority of each 3 x 3 neighbourhood (at least 5 of 9), again and again."""
    d = df.withColumn(out, F.col(mask))
    for _ in range(iterations):
        d = box_sum(d, out, "_v", "f", 1, group)
        d = box_sum(d, "_v", "_v", "t", 1, group).withColumn(out, F.col("_v") >= 5).drop("_v")
    return d


def local_relative_power(df: DataFrame, column: str = "power_db", out: str = "power_support", valid: Column | None = None, floor_q: float = 0.30, size_f: int = 9, size_t: int = 33, group: Sequence[str] = GROUP) -> DataFrame:
    """How far power stands out of its surroundings: dB over a floor quantile of linear power, less its box mean."""
    d = df.withColumn("_lin", from_db(F.col(column))).withColumn("_ok", F.lit(True) if valid is None else valid)
    d = with_scalars(d, group, _f1=F.percentile(F.when(F.col("_ok"), F.col("_lin")), F.lit(floor_q)), _f2=F.percentile("_lin", F.lit(floor_q)))
    d = d.withColumn("_rel", relative_db(F.col("_lin"), F.coalesce("_f1", "_f2")))
    d = box_mean(d, "_rel", "_mean", size_f, size_t, group)
    return d.withColumn(out, F.when(F.col("_ok"), F.greatest(F.col("_rel") - F.col("_mean"), F.lit(0.0))).otherwise(F.lit(0.0))).drop("_lin", "_ok", "_f1", "_f2", "_rel", "_mean")


def residual_background(df: DataFrame, size_f: int, size_t: int, column: str = "power_db", out: str = "residual", group: Sequence[str] = GROUP) -> DataFrame:
    """What stands over a wide box mean, scaled between its 5 % and 99 % quantiles."""
    d = box_mean(df, column, "_bg", size_f, size_t, group).withColumn("_res", F.greatest(F.col(column) - F.col("_bg"), F.lit(0.0)))
    return normalize_local(d, "_res", out, 0.05, 0.99, group).drop("_bg", "_res")


def background_width(n: int) -> int:
    """The width of residual_background's box for an axis of n cells."""
    return max(9, 2 * max(1, n // 24) + 1)


def trend_map(df: DataFrame, rows: int, cols: int, column: str = "power_db", out: str = "trend", group: Sequence[str] = GROUP) -> DataFrame:
    """Smoothed row means plus smoothed column means less the mean of all."""
    parts = {}
    for axis, n in (("f", rows), ("t", cols)):
        means = df.groupBy(*group, axis).agg(F.avg(column).alias("_m"))
        smooth = convolve_axis(means, "_m", f"_{axis}_trend", axis, gaussian_kernel(max(1.0, n / 32)), group=group, line_key=())
        parts[axis] = smooth.select(*[F.col(g).alias(f"_{axis}{g}") for g in group], F.col(axis).alias(f"_{axis}"), f"_{axis}_trend")
    d = with_scalars(df, group, _all=F.avg(column))
    for axis, p in parts.items():
        on = d[axis] == p[f"_{axis}"]
        for g in group:
            on = on & (d[g] == p[f"_{axis}{g}"])
        d = d.join(p, on).drop(f"_{axis}", *[f"_{axis}{g}" for g in group])
    return d.withColumn(out, F.col("_f_trend") + F.col("_t_trend") - F.col("_all")).drop("_f_trend", "_t_trend", "_all")


def signal_agnostic_map(df: DataFrame, rows: int, cols: int, column: str = "power_db", out: str = "grey", group: Sequence[str] = GROUP) -> DataFrame:
    """A grey map 0..255: 0.70 of local contrast (detrended, less its local mean, over its local spread) and 0.30 of the
    detrended map; where the mix hardly varies, the detrended map alone."""
    d = trend_map(df, rows, cols, column, "_tr", group).withColumn("_flat", F.col(column) - F.col("_tr"))
    d = box_mean(d, "_flat", "_mean", 7, 7, group).withColumn("_dev", F.col("_flat") - F.col("_mean")).withColumn("_sq", F.col("_dev") * F.col("_dev"))
    d = box_mean(d, "_sq", "_ms", 9, 9, group).withColumn("_z", F.col("_dev") / F.greatest(F.sqrt(F.greatest(F.col("_ms"), F.lit(0.0)) + 1e-6), F.lit(1e-4)))
    d = signed_to_unit(d, "_z", "_signed", group=group)
    d = normalize_local(d, "_flat", "_norm", 0.02, 0.98, group)
    d = normalize_local(d, "_flat", "_wide", 0.01, 0.99, group).withColumn("_mix", 0.70 * F.col("_signed") + 0.30 * F.col("_norm"))
    d = with_scalars(d, group, _std=F.stddev_pop("_mix"))
    grey = F.when(F.col("_std") < 0.02, F.col("_wide")).otherwise(F.col("_mix"))
    return d.withColumn(out, F.bround(255 * F.least(F.greatest(grey, F.lit(0.0)), F.lit(1.0)), 0)).drop("_tr", "_flat", "_mean", "_dev", "_sq", "_ms", "_z", "_signed", "_norm", "_wide", "_mix", "_std")


def seed_map(df: DataFrame, column: str, out: str = "seed", rising: bool = False, group: Sequence[str] = GROUP) -> DataFrame:
    """0.65 of the normalised mean over time and 0.35 of the normalised local contrast; `rising` takes contrast above 0 only."""
    d = box_mean(df, column, "_time", 1, 7, group)
    d = box_mean(d, column, "_box", 5, 5, group).withColumn("_c", F.col(column) - F.col("_box"))
    if rising:
        d = d.withColumn("_c", F.greatest("_c", F.lit(0.0)))
    d = normalize_local(d, "_time", "_a", group=group)
    d = normalize_local(d, "_c", "_b", group=group)
    return d.withColumn(out, 0.65 * F.col("_a") + 0.35 * F.col("_b")).drop("_time", "_box", "_c", "_a", "_b")


def power_seeds(df: DataFrame, column: str = "power_db", out: str = "seed", local: bool = False, valid: Column | None = None, group: Sequence[str] = GROUP) -> DataFrame:
    """Seeds of power: seed_map of the dB over the 30 % floor, -10 to 25. `local` takes what stands out of its surroundings
    instead (local_relative_power, valid rows only), and contrast above 0."""
    if local:
        return seed_map(local_relative_power(df, column, "_stands", valid, group=group), "_stands", out, True, group).drop("_stands")
    d = df.withColumn("_lin", from_db(F.col(column)))
    d = with_scalars(d, group, _floor=F.percentile("_lin", F.lit(0.30))).withColumn("_rel", relative_db(F.col("_lin"), F.col("_floor"), -10.0))
    return seed_map(d, "_rel", out, False, group).drop("_lin", "_floor", "_rel")


def burst_companion(df: DataFrame, cols: int, gate: str, residual: str, out: str = "companion", group: Sequence[str] = GROUP) -> DataFrame:
    """Evidence for short bursts: residual, its rise over its own time mean, and gate, each normalised, mixed .45/.35/.20."""
    d = normalize_local(df, residual, "_a", 0.05, 0.99, group)
    d = box_mean(d, "_a", "_m", 1, max(5, 2 * max(1, cols // 32) + 1), group).withColumn("_rise", F.greatest(F.col("_a") - F.col("_m"), F.lit(0.0)))
    d = normalize_local(d, "_rise", "_b", 0.05, 0.99, group)
    d = normalize_local(d, gate, "_c", 0.05, 0.99, group).withColumn("_mix", 0.45 * F.col("_a") + 0.35 * F.col("_b") + 0.20 * F.col("_c"))
    return normalize_local(d, "_mix", out, 0.05, 0.99, group).drop("_m", "_rise", "_a", "_b", "_c", "_mix")


def dilate(df: DataFrame, mask: str, out: str, axis: str, size: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Outside counts as false; for even sizes the frame reaches one cell further back than ahead."""
    line = _line(axis, group).rowsBetween(-(size // 2), (size - 1) // 2)
    return df.withColumn(out, F.max(F.col(mask)).over(line))


def erode(df: DataFrame, mask: str, out: str, axis: str, size: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Outside counts as false, so what lies within half a frame of an edge goes."""
    line = _line(axis, group).rowsBetween(-((size - 1) // 2), size // 2)
    return df.withColumn(out, F.min(F.col(mask)).over(line) & (F.count(F.lit(1)).over(line) == size))


def closing(df: DataFrame, mask: str, out: str, size_f: int = 1, size_t: int = 1, group: Sequence[str] = GROUP) -> DataFrame:
    d = df.withColumn(out, F.col(mask))
    for step in (dilate, erode):
        for axis, size in (("f", size_f), ("t", size_t)):
            if size > 1:
                d = step(d, out, out, axis, size, group)
    return d


def opening(df: DataFrame, mask: str, out: str, size_f: int = 1, size_t: int = 1, group: Sequence[str] = GROUP) -> DataFrame:
    d = df.withColumn(out, F.col(mask))
    for step in (erode, dilate):
        for axis, size in (("f", size_f), ("t", size_t)):
            if size > 1:
                d = step(d, out, out, axis, size, group)
    return d


def true_runs(df: DataFrame, mask: str, axis: str = "t", group: Sequence[str] = GROUP) -> DataFrame:
    """(group, line, start, stop) of the runs of true cells along an axis; stop is exclusive."""
    other = "f" if axis == "t" else "t"
    w = Window.partitionBy(*group, other).orderBy(axis)
    on = df.where(F.col(mask)).select(*group, other, axis).withColumn("_i", F.col(axis) - F.row_number().over(w))
    return on.groupBy(*group, other, "_i").agg(F.min(axis).alias("start"), (F.max(axis) + 1).alias("stop")).drop("_i")


def fill_gaps(df: DataFrame, mask: str, out: str, max_gap: int = 3, ratio: float = 0.85, group: Sequence[str] = GROUP) -> DataFrame:
    """Short gaps in time between two runs of a row become true where the runs fill most of their common span."""
    runs = true_runs(df, mask, "t", group)
    line = Window.partitionBy(*group, "f").orderBy("start")
    runs = runs.withColumn("_next", F.lead("start").over(line)).withColumn("_next_stop", F.lead("stop").over(line))
    gap, left, right = F.col("_next") - F.col("stop"), F.col("stop") - F.col("start"), F.col("_next_stop") - F.col("_next")
    gaps = runs.where((gap <= max_gap) & ((left + right) / (left + gap + right) >= ratio))
    cells = gaps.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), F.explode(F.sequence(F.col("stop"), F.col("_next") - 1)).alias("_t"))
    on = (df["f"] == F.col("_f")) & (df["t"] == F.col("_t"))
    for g in group:
        on = on & (df[g] == F.col(f"_{g}"))
    return df.join(cells, on, "left").withColumn(out, F.col(mask) | F.col("_t").isNotNull()).drop("_f", "_t", *[f"_{g}" for g in group])


def sobel_magnitude(df: DataFrame, column: str, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Length of the Sobel gradient, edge values repeated."""

    def along(d: DataFrame, src: str, dst: str, axis: str, weights: tuple[int, int, int]) -> DataFrame:
        line = _line(axis, group)
        x = F.col(src)
        return d.withColumn(dst, weights[0] * F.coalesce(F.lag(src).over(line), x) + weights[1] * x + weights[2] * F.coalesce(F.lead(src).over(line), x))

    d = along(df, column, "_df", "f", (-1, 0, 1))
    d = along(d, "_df", "_df", "t", (1, 2, 1))
    d = along(d, column, "_dt", "t", (-1, 0, 1))
    d = along(d, "_dt", "_dt", "f", (1, 2, 1))
    return d.withColumn(out, F.sqrt(F.col("_df") * F.col("_df") + F.col("_dt") * F.col("_dt"))).drop("_df", "_dt")


def wrapped_neighbours(df: DataFrame, column: str, rows: int, cols: int, offsets: Sequence[tuple[int, int]], group: Sequence[str] = GROUP, r: str = "f", c: str = "t") -> DataFrame:
    """A row for each cell and offset with the neighbour's value; the grid wraps around."""
    steps = df.sparkSession.createDataFrame([(int(a), int(b)) for a, b in offsets], "dr int, dc int")
    at = df.crossJoin(F.broadcast(steps)).withColumn("_r", F.pmod(F.col(r) + F.col("dr"), F.lit(rows))).withColumn("_c", F.pmod(F.col(c) + F.col("dc"), F.lit(cols)))
    other = df.select(*[F.col(g).alias(f"n_{g}") for g in group], F.col(r).alias("n_r"), F.col(c).alias("n_c"), F.col(column).alias("neighbour"))
    on = (F.col("_r") == F.col("n_r")) & (F.col("_c") == F.col("n_c"))
    for g in group:
        on = on & (F.col(g) == F.col(f"n_{g}"))
    return at.join(other, on).drop("_r", "_c", "n_r", "n_c", *[f"n_{g}" for g in group])


def gaussian_smooth(df: DataFrame, column: str, out: str, sigma: float, group: Sequence[str] = GROUP) -> DataFrame:
    """A map smoothed on both axes, mirrored at the edges (the edge cell doubled)."""
    d = convolve_axis(df, column, out, "f", gaussian_kernel(sigma), "mirror", group)
    return convolve_axis(d, out, out, "t", gaussian_kernel(sigma), "mirror", group)


def min_max(df: DataFrame, column: str, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn(out, (F.col(column) - F.min(column).over(w)) / (F.max(column).over(w) - F.min(column).over(w) + 1e-8))


def incoherence(df: DataFrame, column: str, out: str, rows: int, cols: int, previous: str | None = None, group: Sequence[str] = GROUP) -> DataFrame:
    """How much each cell disagrees with its neighbours (sides .1875, two diagonals .125 each, the grid wrapping around) and,
    by .22, with the cell of the frame before (column `previous`, null: none); both parts smoothed and min-max scaled."""
    weights = {(1, 0): 0.1875, (-1, 0): 0.1875, (0, 1): 0.1875, (0, -1): 0.1875, (-1, -1): 0.125, (-1, 1): 0.125}
    near = wrapped_neighbours(df, column, rows, cols, list(weights), group)
    w = F.lit(0.0)
    for (a, b), value in weights.items():
        w = F.when((F.col("dr") == a) & (F.col("dc") == b), F.lit(value)).otherwise(w)
    d = near.groupBy(*group, "f", "t").agg(F.sum(w * F.abs(F.col(column) - F.col("neighbour"))).alias("_spatial"))
    on = (df["f"] == F.col("_f")) & (df["t"] == F.col("_t"))
    d = d.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), F.col("t").alias("_t"), "_spatial")
    for g in group:
        on = on & (df[g] == F.col(f"_{g}"))
    d = stored(df.join(d, on).drop("_f", "_t", *[f"_{g}" for g in group]), "incoherence")
    d = min_max(gaussian_smooth(d, "_spatial", "_spatial", 0.7, group), "_spatial", "_spatial", group)
    if previous is None:
        return d.withColumn(out, 0.78 * F.col("_spatial")).drop("_spatial")
    d = d.withColumn("_change", F.coalesce(F.abs(F.col(column) - F.col(previous)), F.lit(0.0)))
    d = min_max(gaussian_smooth(d, "_change", "_change", 0.7, group), "_change", "_change", group)
    return d.withColumn(out, F.least(F.greatest(0.78 * F.col("_spatial") + 0.22 * F.col("_change"), F.lit(0.0)), F.lit(1.0))).drop("_spatial", "_change")
