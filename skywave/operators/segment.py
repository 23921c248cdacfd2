"""Noise-probability heads and masks from them; the signal is where the noise probability is low."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.functions.quantiles import GROUP, minmax, with_scalars
from skywave.kernels.arrays import mixture_threshold
from skywave.operators.components import component_cells, component_table, connected_components
from skywave.operators.graph import dot, unit_vectors
from skywave.operators.patches import zoom
from skywave.operators.windows import convolve_axis, dilate, gaussian_kernel, gaussian_smooth, sobel_magnitude, wrapped_neighbours


def mixture_thresholds(df: DataFrame, group: Sequence[str] = GROUP, column: str = "p") -> DataFrame:
    """(group, threshold, gap, spread, separation): null where a group has no two clear parts."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        t, gap, spread, separation = mixture_threshold(p[column].to_numpy(float))
        return pd.DataFrame({**{g: [p[g].iloc[0]] for g in group}, "threshold": [t], "gap": [gap], "spread": [spread], "separation": [separation]})

    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", threshold double, gap double, spread double, separation double"
    return df.select(*group, column).groupBy(*group).applyInPandas(fit, schema).withColumn("threshold", F.when(F.isnan("threshold"), None).otherwise(F.col("threshold")))


def hysteresis(df: DataFrame, column: str, tau: str, out: str, rounds: int = 2, group: Sequence[str] = GROUP) -> DataFrame:
    """Cells of surely low noise, grown over the eight neighbours into cells of rather low noise."""
    d = with_scalars(df, group, _q=F.percentile(column, F.array(F.lit(0.25), F.lit(0.45))))
    d = d.withColumn("_low", F.greatest(F.lit(0.01), F.least(F.col(tau) - 0.04, F.col("_q")[0])))
    high = F.least(F.lit(0.99), F.least(F.col(tau) + 0.015, F.col("_q")[1]))
    high = F.when(high <= F.col("_low"), F.least(F.lit(0.99), F.col("_low") + 0.03)).otherwise(high)
    d = d.withColumn("_weak", F.col(column) < high).withColumn(out, F.col(column) < F.col("_low"))
    for _ in range(rounds):
        for axis in ("f", "t"):
            d = dilate(d, out, out, axis, 3, group)
        d = d.withColumn(out, F.col(out) & F.col("_weak"))
    return d.drop("_weak", "_q", "_low")


def manifold_head(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, p): sigmoid of the standardised mean distance to the nearest neighbours."""
    m = edges.groupBy(*group, F.col("src").alias("node")).agg(F.avg("distance").alias("m"))
    m = with_scalars(m, group, _mean=F.avg("m"), _spread=F.stddev_pop("m"))
    return m.select(*group, "node", (1 / (1 + F.exp(-(F.col("m") - F.col("_mean")) / (F.col("_spread") + 1e-8)))).alias("p"))


def uncertainty(df: DataFrame, column: str, group: Sequence[str], key: str) -> DataFrame:
    """(group, key, uncertainty): binary entropy of the mean over several looks, min-max scaled in the group."""
    m = df.groupBy(*group, key).agg(F.avg(column).alias("m"))
    h = lambda x: F.greatest(x, F.lit(1e-6)) * F.log2(F.greatest(x, F.lit(1e-6)))
    w = Window.partitionBy(*group)
    m = m.withColumn("e", -(h(F.col("m")) + h(1 - F.col("m"))))
    return m.select(*group, key, ((F.col("e") - F.min("e").over(w)) / (F.max("e").over(w) - F.min("e").over(w) + 1e-8)).alias("uncertainty"))


def cell_cues(df: DataFrame, rows: int, cols: int, ph: int, pw: int, column: str = "power_db", group: Sequence[str] = GROUP) -> DataFrame:
    """(group, pr, pc, residual, gradient): how far power stands over its row's smoothed floor, and how steep it is, on
    patches, each min-max scaled."""
    floors = df.groupBy(*group, "f").agg(F.percentile(column, F.lit(0.20)).alias("_q"))
    floors = convolve_axis(floors, "_q", "_floor", "f", gaussian_kernel(1.0), "mirror", group, line_key=()).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_row"), "_floor")
    on = df["f"] == F.col("_row")
    for g in group:
        on = on & (df[g] == F.col(f"_{g}"))
    d = df.join(floors, on).select(*group, "f", "t", F.col(column).alias("_power"), (F.col(column) - F.col("_floor")).alias("_over"))
    over = minmax(zoom(d, "_over", rows, cols, ph, pw, group), "value", "residual", group).drop("value")
    power = minmax(zoom(d, "_power", rows, cols, ph, pw, group), "value", "_p", group).select(*group, F.col("pr").alias("f"), F.col("pc").alias("t"), "_p")
    steep = minmax(sobel_magnitude(power, "_p", "_g", group), "_g", "gradient", group).select(*group, F.col("f").alias("pr"), F.col("t").alias("pc"), "gradient")
    return over.join(steep, [*group, "pr", "pc"])


def feature_cues(patches: DataFrame, edges: DataFrame, rows: int, cols: int, group: Sequence[str]) -> DataFrame:
    """(group, node, density, coherence): how close the nearest features are, and how alike those of the four sides (the
    grid wraps around), each min-max scaled. A patch without neighbours has density 0."""
    dense = edges.groupBy(*group, F.col("src").alias("node")).agg((1 / (F.avg("distance") + 1e-8)).alias("_d"))
    near = wrapped_neighbours(unit_vectors(patches.select(*group, "node", "pr", "pc", "x")), "x", rows, cols, [(0, 1), (0, -1), (1, 0), (-1, 0)], group, "pr", "pc")
    alike = near.groupBy(*group, "node").agg(F.avg(dot(F.col("x"), F.col("neighbour"))).alias("_c"))
    d = patches.select(*group, "node").join(dense, [*group, "node"], "left").join(alike, [*group, "node"], "left")
    d = minmax(minmax(d, "_d", "density", group), "_c", "coherence", group)
    return d.select(*group, "node", F.coalesce("density", F.lit(0.0)).alias("density"), F.coalesce("coherence", F.lit(0.0)).alias("coherence"))


def signal_prior(df: DataFrame, residual: str, coherence: str, incoherent: str, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """What speaks for a signal: .50 residual, .30 alike features, .20 steady neighbourhood, scaled to 0..1."""
    d = minmax(minmax(df, residual, "_r", group), coherence, "_c", group)
    d = d.withColumn("_mix", 0.50 * F.col("_r") + 0.30 * F.col("_c") + 0.20 * (1 - F.col(incoherent)))
    return minmax(d, "_mix", out, group).drop("_r", "_c", "_mix")


def refine(df: DataFrame, column: str, incoherent: str, prior: str, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """A noise probability raised where neighbours disagree and lowered where the prior speaks for a signal, smoothed."""
    d = df.withColumn("_raised", F.col(column) + 0.11 * F.col(incoherent) - 0.18 * F.col(prior))
    d = gaussian_smooth(d, "_raised", "_smooth", 0.55, group)
    return d.withColumn(out, F.least(F.greatest(F.col("_smooth"), F.lit(0.0)), F.lit(1.0))).drop("_raised", "_smooth")


def least_spans(sample_rate_hz: float, hop: int, cols: int, ph: int, pw: int, duration_us: float, bandwidth_khz: float) -> tuple[int, int]:
    """(rows, columns) of patches that a signal of the least bandwidth and duration covers; cols are the frame's columns of hop samples."""
    seconds, hertz = max(cols * max(hop, 1) / sample_rate_hz / pw, 1e-9), max(sample_rate_hz / ph, 1e-6)
    return max(1, -int(-bandwidth_khz * 1e3 // hertz)), max(1, -int(-duration_us * 1e-6 // seconds))


def persistence_filter(df: DataFrame, mask: str, column: str, min_f: int, min_t: int, boost: float = 0.20, group: Sequence[str] = GROUP) -> DataFrame:
    """The mask without parts that are too narrow, too short or too small; there the noise probability rises by `boost`."""
    cells = component_cells(connected_components(df, mask, False, group), group)
    table = component_table(cells, group=group)
    small = (F.col("freq_span") < min_f) | (F.col("time_span") < min_t) | (F.col("filled_area") < max(4, int(0.22 * min_f * min_t)))
    gone = cells.join(table.where(small).select(*group, "component"), [*group, "component"], "left_semi")
    gone = gone.select(*group, "f", "t", F.lit(True).alias("_gone"))
    d = df.join(gone, [*group, "f", "t"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    raised = F.least(F.greatest(F.col(column) + boost, F.lit(0.0)), F.lit(1.0))
    return d.withColumn(column, F.when(F.col("_gone"), raised).otherwise(F.col(column))).withColumn(mask, F.col(mask) & ~F.col("_gone")).drop("_gone")


def coverage_guard(df: DataFrame, mask: str, column: str, group: Sequence[str] = GROUP) -> DataFrame:
    """A mask over more than 55 % of a group whose mean noise probability is over .56 is dropped; `guarded` tells so."""
    d = with_scalars(df, group, _share=F.avg(F.col(mask).cast("double")), _mean=F.avg(column))
    d = d.withColumn("guarded", (F.col("_share") > 0.55) & (F.col("_mean") > 0.56))
    return d.withColumn(mask, F.col(mask) & ~F.col("guarded")).drop("_share", "_mean")
