"""Connected components of masks, by runs, and what is made of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.config import Grouping
from skywave.functions.quantiles import GROUP, with_scalars
from skywave.kernels.grouping import group_mask
from skywave.operators import links
from skywave.operators.windows import closing, fill_gaps, majority_votes, true_runs
from skywave.sources.tables import stored


def _label_runs(eight: bool):
    """Numbers connected runs of one frame in the order of their first runs."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        f, start, stop = (t.column(c).to_numpy() for c in ("f", "start", "stop"))
        order = np.lexsort((start, f))
        f, start, stop = f[order], start[order], stop[order]
        root = np.arange(len(f))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        reach = 1 if eight else 0
        rows, first = np.unique(f, return_index=True)
        last = np.append(first[1:], len(f))
        for k in range(1, len(rows)):
            if rows[k] != rows[k - 1] + 1:
                continue
            i, j = first[k - 1], first[k]  # both rows' runs in order of time: one pass meets all that touch
            while i < last[k - 1] and j < last[k]:
                if start[i] < stop[j] + reach and start[j] < stop[i] + reach:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
                if stop[i] < stop[j]:
                    i += 1
                else:
                    j += 1
        tops = np.array([find(x) for x in range(len(f))], np.int64)
        number = np.unique(tops, return_inverse=True)[1] + 1
        cols = {f"_k{i}": pa.array([v.as_py()] * len(f), v.type) for i, v in enumerate(key)}
        return pa.table(cols | {"f": pa.array(f), "start": pa.array(start), "stop": pa.array(stop), "component": pa.array(number.astype(np.int32))})

    return run


def _border_links(key: tuple, t: pa.Table) -> pa.Table:
    """(a, b) of the nodes whose runs meet across a border, a node's runs on its two sides; t has (upper, start, stop, node)."""
    upper = t.column("upper").to_numpy(zero_copy_only=False)
    sides = []
    for side in (upper, ~upper):
        start, stop, node = (t.column(c).to_numpy()[side] for c in ("start", "stop", "node"))
        order = np.argsort(start)
        sides.append((start[order], stop[order], node[order]))
    (start, stop, node), (start2, stop2, node2) = sides
    reach = int(t.column("reach")[0].as_py())
    # runs of a row are apart and in order: those that a run meets follow one another
    first, last = np.searchsorted(stop2, start - reach, side="right"), np.searchsorted(start2, stop + reach, side="left")
    many = np.maximum(last - first, 0)
    at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return pa.table({"a": np.repeat(node, many), "b": node2[at]})


def connected_components(df: DataFrame, mask: str, eight: bool = False, group: Sequence[str] = GROUP, band: int | None = None) -> DataFrame:
    """(group, f, start, stop, component) of the runs of a mask; component is the group's number for connected runs.

    Runs of neighbouring rows touch where they overlap (with eight neighbours: where they meet at a corner as well). The
    runs of one frame, far fewer than its cells, are labelled in one task. For frames too large for that, `band` rows are
    labelled in a task each, and what meets across the bands' borders is joined by connected_components of links; the
    numbers are the same.
    """
    runs = true_runs(df, mask, "t", group)
    keys = list(group)
    if band is not None:
        keys, runs = [*group, "_band"], stored(runs.withColumn("_band", F.floor(F.col("f") / band).cast("long")), "runs")
    types = {x.name: x.dataType.simpleString() for x in runs.schema}
    schema = ", ".join(f"_k{i} {types[g]}" for i, g in enumerate(keys)) + f", f {types['f']}, start {types['start']}, stop {types['stop']}, component int"
    named = runs.groupBy(*keys).applyInArrow(_label_runs(eight), schema)
    named = named.select(*[F.col(f"_k{i}").alias(g) for i, g in enumerate(keys)], "f", "start", "stop", "component")
    return named if band is None else _across_bands(named, eight, group, band)


def _across_bands(named: DataFrame, eight: bool, group: Sequence[str], band: int) -> DataFrame:
    """The runs of components labelled in bands with the frames' numbers of what is connected across the bands."""
    named = stored(named, "band-runs")
    keys = [*group, "_band", "component"]
    parts = named.groupBy(*keys).agg(F.min(F.struct("f", "start")).alias("_first"))
    parts = stored(parts.withColumn("node", F.monotonically_increasing_id()), "band-parts")
    row = F.pmod(F.col("f"), F.lit(band))
    rims = named.where((row == 0) | (row == band - 1)).join(parts.drop("_first"), keys)
    # a band's last row lies above the border to the next one; a band of one row has both
    sides = F.array(F.when(row == band - 1, F.struct(F.col("_band").alias("border"), F.lit(True).alias("upper"))), F.when(row == 0, F.struct((F.col("_band") - 1).alias("border"), F.lit(False).alias("upper"))))
    rims = rims.withColumn("_s", F.explode(F.filter(sides, lambda x: x.isNotNull())))
    rims = rims.select(*group, "_s.border", "_s.upper", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "node", F.lit(1 if eight else 0).alias("reach"))
    edges = rims.groupBy(*group, "border").applyInArrow(_border_links, "a long, b long")
    roots = links.connected_components(edges, "band-links")
    whole = parts.join(roots.select(F.col("node").alias("_node"), F.col("component").alias("_root")), F.col("node") == F.col("_node"), "left")
    whole = whole.withColumn("_root", F.coalesce("_root", "node"))
    firsts = whole.groupBy(*group, "_root").agg(F.min("_first").alias("_first"))
    numbers = firsts.withColumn("_number", F.row_number().over(Window.partitionBy(*group).orderBy("_first"))).select(F.col("_root").alias("_r"), "_number")
    numbered = whole.join(numbers, F.col("_root") == F.col("_r")).select(*keys, "_number")
    return named.join(numbered, keys).select(*group, "f", "start", "stop", F.col("_number").cast("int").alias("component"))


def component_cells(components: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, f, t, component) of the runs' cells."""
    return components.select(*group, "f", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("t"), "component")


def component_table(cells: DataFrame, score: DataFrame | None = None, score_col: str = "score", group: Sequence[str] = GROUP, parts: Sequence[str] = ()) -> DataFrame:
    """A row for each component (and each of its parts, by the columns named): bounds (stops exclusive), filled area, box density, score mean and peak."""
    d = cells
    if score is not None:
        s = score.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), F.col("t").alias("_t"), F.col(score_col).alias("_score"))
        on = (d.f == F.col("_f")) & (d.t == F.col("_t"))
        for g in group:
            on = on & (d[g] == F.col(f"_{g}"))
        d = d.join(s, on)
    else:
        d = d.withColumn("_score", F.lit(0.0))
    t = d.groupBy(*group, "component", *parts).agg(
        F.min("f").alias("freq_start"), (F.max("f") + 1).alias("freq_stop"), F.min("t").alias("time_start"), (F.max("t") + 1).alias("time_stop"), F.count("*").alias("filled_area"), F.avg("_score").alias("score_mean"), F.max("_score").alias("score_peak")
    )
    t = t.withColumn("freq_span", F.col("freq_stop") - F.col("freq_start")).withColumn("time_span", F.col("time_stop") - F.col("time_start"))
    return t.withColumn("bbox_density", F.col("filled_area") / (F.col("freq_span") * F.col("time_span")))


def envelope_area(cells: DataFrame, group: Sequence[str] = GROUP, parts: Sequence[str] = ()) -> DataFrame:
    """(group, component, envelope_area): over the component's columns, the rows from its first to its last."""
    columns = cells.groupBy(*group, "component", *parts, "t").agg((F.max("f") - F.min("f") + 1).alias("span"))
    return columns.groupBy(*group, "component", *parts).agg(F.sum("span").alias("envelope_area"))


def remove_small(df: DataFrame, mask: str, out: str, least: int | Column, group: Sequence[str] = GROUP, eight: bool = False) -> DataFrame:
    """The mask without components of fewer than `least` cells; a column gives each group its own minimum."""
    if isinstance(least, int) and least <= 1:
        return df.withColumn(out, F.col(mask))
    runs = connected_components(df, mask, eight, group)
    if not isinstance(least, int):
        minima = df.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.max(least).alias("_least"))
        runs = runs.join(minima, _on(runs, group))
    size = F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy(*group, "component"))
    cells = component_cells(runs.withColumn("_size", size).where(F.col("_size") >= (F.lit(least) if isinstance(least, int) else F.col("_least"))), group)
    return mark(df, cells, out, group)


def mark(df: DataFrame, cells: DataFrame, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """df with `out`: whether the cell is among `cells`."""
    c = cells.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), F.col("t").alias("_t")).distinct()
    on = (df.f == F.col("_f")) & (df.t == F.col("_t"))
    for g in group:
        on = on & (df[g] == F.col(f"_{g}"))
    return df.join(c, on, "left").withColumn(out, F.col("_f").isNotNull()).drop("_f", "_t", *[f"_{g}" for g in group])


def fill_holes(df: DataFrame, mask: str, out: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Background that is not connected to the grid's border becomes foreground."""
    d = df.withColumn("_bg", ~F.col(mask))
    runs = connected_components(d, "_bg", False, group)
    edges = df.groupBy(*group).agg(F.min("f").alias("f0"), F.max("f").alias("f1"), F.min("t").alias("t0"), (F.max("t") + 1).alias("t1")).select(*[F.col(g).alias(f"_{g}") for g in group], "f0", "f1", "t0", "t1")
    on = F.lit(True)
    for g in group:
        on = on & (runs[g] == F.col(f"_{g}"))
    touched = runs.join(edges, on).withColumn("border", (F.col("f") == F.col("f0")) | (F.col("f") == F.col("f1")) | (F.col("start") == F.col("t0")) | (F.col("stop") == F.col("t1")))
    holes = touched.withColumn("_open", F.max("border").over(Window.partitionBy(*group, "component"))).where("not _open").select(*group, "f", "start", "stop", "component")
    return mark(d, component_cells(holes, group), "_hole", group).withColumn(out, F.col(mask) | F.col("_hole")).drop("_bg", "_hole")


def smooth_labels(df: DataFrame, mask: str, out: str, iterations: int = 2, least: int = 6, group: Sequence[str] = GROUP) -> DataFrame:
    """A mask after rounds of 3 x 3 majority votes; parts of fewer than `least` cells are put to the vote once more."""
    d = stored(majority_votes(df, mask, "_voted", iterations, group), "voted")
    d = remove_small(d, "_voted", "_large", least, group)
    d = majority_votes(d, "_voted", "_again", 1, group)
    return d.withColumn(out, F.col("_large") | (F.col("_voted") & F.col("_again"))).drop("_voted", "_large", "_again")


def _on(d: DataFrame, keys: Sequence[str], also=None):
    """Equality of d's keys with the same names led by an underscore."""
    on = F.lit(True) if also is None else also
    for k in keys:
        on = on & (d[k] == F.col(f"_{k}"))
    return on


def _keyed(t: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return t.select(*[F.col(k).alias(f"_{k}") for k in keys], *more)


def split_components(cells: DataFrame, min_f: int = 12, min_t: int = 1, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, component, part, f, t, split_role): components of a carrier with wideband bursts come apart.

    A burst column spans clearly more rows than usual (the 35 % quantile of the spans); runs of burst columns that are
    short against the component are bursts, a part each, numbered from 1. The carrier, part 0, is the longest run of rows
    that enough of the other columns hold. A component stays whole (unsplit, part 0) unless it has at least one burst and a
    carrier; that it has few columns or quiet ones, that no column can be wider than usual, or that the carrier is thin, as
    wide as a burst or small, all rule that out. Cells may belong to the carrier and to a burst.
    """
    keys = [*group, "component"]
    cells = cells.select(*keys, "f", "t")
    columns = cells.groupBy(*keys, "t").agg(F.min("f").alias("_lo"), F.max("f").alias("_hi")).withColumn("span", F.col("_hi") - F.col("_lo") + 1)
    d = with_scalars(columns, keys, q35=F.percentile("span", F.lit(0.35)), active=F.count("*"), rows=F.max("_hi") - F.min("_lo") + 1)
    wide = F.greatest(F.ceil(1.8 * F.col("q35")), F.ceil(F.col("q35") + F.greatest(F.lit(4.0), F.lit(0.5 * min_f))), F.lit(min_f))
    d = d.withColumn("wide", wide).where((F.col("active") >= max(6, 2 * min_t)) & (F.col("wide") < F.col("rows")))
    d = stored(d.withColumn("burst", F.col("span") >= F.col("wide")).drop("_lo", "_hi"), "columns")
    w = Window.partitionBy(*keys).orderBy("t")
    burst = d.where("burst").withColumn("_i", F.col("t") - F.row_number().over(w))
    runs = burst.groupBy(*keys, "_i").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b"), F.first("active").alias("active"))
    length = F.col("b") - F.col("a")
    runs = runs.where((length >= min_t) & (length < F.greatest(F.floor(0.7 * F.col("active")), F.lit(min_t + 1))))
    runs = runs.withColumn("part", F.row_number().over(Window.partitionBy(*keys).orderBy("a"))).select(*keys, "a", "b", "part")

    quiet = d.where("not burst")
    calm = cells.join(_keyed(quiet, keys, F.col("t").alias("_t")), _on(cells, keys, cells.t == F.col("_t"))).select(*keys, "f")
    hits = calm.groupBy(*keys, "f").agg(F.count("*").alias("hits"))
    facts = _keyed(quiet.groupBy(*keys).agg(F.count("*").alias("quiet"), F.first("q35").alias("q35"), F.first("wide").alias("wide")), keys, "quiet", "q35", "wide")
    steady = hits.join(facts, _on(hits, keys)).where((F.col("quiet") >= max(4, 2 * min_t)) & (F.col("hits") >= F.greatest(F.lit(2), F.ceil(0.45 * F.col("quiet")))))
    rows = steady.withColumn("_i", F.col("f") - F.row_number().over(Window.partitionBy(*keys).orderBy("f"))).groupBy(*keys, "_i").agg(F.min("f").alias("fa"), (F.max("f") + 1).alias("fb"), F.first("q35").alias("q35"), F.first("wide").alias("wide"))
    height = F.col("fb") - F.col("fa")
    longest = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(height.desc(), "fa"))).where("_r = 1")
    longest = longest.where((height >= F.greatest(F.lit(2), F.floor("q35"))) & (height < F.col("wide")))
    carrier = cells.join(_keyed(longest, keys, "fa", "fb"), _on(cells, keys, (cells.f >= F.col("fa")) & (cells.f < F.col("fb")))).select(*keys, "f", "t")
    large = carrier.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= max(2, 2 * min_t))

    split = _keyed(stored(large.select(*keys).intersect(runs.select(*keys)), "split"), keys)
    bursts = cells.join(_keyed(runs, keys, "a", "b", "part"), _on(cells, keys, (cells.t >= F.col("a")) & (cells.t < F.col("b")))).select(*keys, "part", "f", "t")
    return (
        bursts.join(split, _on(bursts, keys), "left_semi").withColumn("split_role", F.lit("transient_wideband_burst"))
        .unionByName(carrier.join(split, _on(carrier, keys), "left_semi").withColumn("part", F.lit(0)).withColumn("split_role", F.lit("persistent_carrier")))
        .unionByName(cells.join(split, _on(cells, keys), "left_anti").withColumn("part", F.lit(0)).withColumn("split_role", F.lit("unsplit")))
    )


def regions(df: DataFrame, mask: str, score: str = "score", settings: Grouping = Grouping(), group: Sequence[str] = GROUP, bridged: bool = True, valid: str | None = None, band: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What group_regions returns, and the cells (group, component, part, f, t) of the parts that are kept; `band`: see
    connected_components."""
    d = df.withColumn("_seed", F.col(mask) if valid is None else F.col(mask) & F.col(valid))
    d = with_scalars(d, group, peak_floor=F.coalesce(F.percentile(F.when(F.col("_seed"), F.col(score)), F.lit(0.5)), F.lit(0.0)))
    if bridged:
        d = closing(d, "_seed", "_closed", settings.bridge_f, 1, group)
        d = fill_gaps(d, "_closed", "_bridged", settings.bridge_t, settings.continuity, group)
    else:
        d = d.withColumn("_bridged", F.col("_seed"))
    d = stored(d, "bridged")
    keys = [*group, "component", "part"]
    cells = stored(split_components(stored(component_cells(connected_components(d, "_bridged", False, group, band), group), "cells"), settings.min_f, settings.min_t, group), "parts")
    table = component_table(cells, d, score, group, ("part", "split_role"))
    env = _keyed(envelope_area(cells, group, ("part",)), keys, "envelope_area")
    table = table.join(env, _on(table, keys)).drop(*[f"_{k}" for k in keys])
    floors = _keyed(d.select(*group, "peak_floor").distinct(), group, "peak_floor")
    table = table.join(floors, _on(table, group)).drop(*[f"_{g}" for g in group]).withColumn("density", F.col("filled_area") / F.col("envelope_area"))
    tests = [("size", F.col("filled_area") >= settings.min_size), ("freq_span", F.col("freq_span") >= settings.min_f), ("time_span", F.col("time_span") >= settings.min_t), ("density", F.col("density") >= settings.min_density), ("peak", F.col("score_peak") >= F.col("peak_floor"))]
    reasons = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests]), lambda x: x.isNotNull())
    table = table.withColumn("failed_reasons", reasons).withColumn("keep", F.size("failed_reasons") == 0).withColumn("failed_reason", F.when(~F.col("keep"), F.col("failed_reasons")[0]))
    table = stored(table, "regions")
    kept = cells.join(_keyed(table.where("keep"), keys), _on(cells, keys), "left_semi").select(*keys, "f", "t")
    if valid is not None:
        rows = df.where(F.col(valid)).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f")).distinct()
        kept = kept.join(rows, _on(kept, group, kept.f == F.col("_f")), "left_semi")
    return table, kept


def group_regions(df: DataFrame, mask: str, score: str = "score", settings: Grouping = Grouping(), group: Sequence[str] = GROUP, bridged: bool = True, valid: str | None = None) -> DataFrame:
    """Components of a bridged mask with the tests they pass: bounds, areas, densities, scores, role, keep, failed_reasons.

    Bridging closes gaps of rows, then short gaps in time. Components with bursts come apart (split_components), and each
    part is a row. A part is kept when it passes all five tests: size, rows, columns, envelope density and peak (at least
    the median score of the mask's cells). Where a column names the valid rows, others hold no mask.
    """
    return regions(df, mask, score, settings, group, bridged, valid)[0]


def group_frames(df: DataFrame, mask: str, score: str = "score", settings: Grouping = Grouping(), group: Sequence[str] = GROUP, valid: str | None = None) -> DataFrame:
    """group_regions with a frame's grid in one task: one shuffle instead of a dozen, for frames that fit in a task."""
    types = {x.name: x.dataType.simpleString() for x in df.schema}
    d = df.select(*group, "f", "t", (F.col(mask) if valid is None else F.col(mask) & F.col(valid)).alias("_seed"), F.col(score).alias("_score"))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        f0, t0 = int(p["f"].min()), int(p["t"].min())
        shape = int(p["f"].max()) - f0 + 1, int(p["t"].max()) - t0 + 1
        m, x = np.zeros(shape, bool), np.zeros(shape)
        at = p["f"].to_numpy() - f0, p["t"].to_numpy() - t0
        m[at], x[at] = p["_seed"].to_numpy(bool), p["_score"].to_numpy(float)
        rows = []
        for r in group_mask(m, x, settings):
            a, b, c, e = r.box
            rows.append((*key, r.component, r.part, r.role, a + f0, b + f0, c + t0, e + t0, len(r.f), r.mean, r.peak, r.density, r.failed, not r.failed, r.failed[0] if r.failed else None))
        return pd.DataFrame(rows, columns=[*group, *_FRAME_PARTS])

    schema = ", ".join([*(f"{g} {types[g]}" for g in group), *(f"{n} {t}" for n, t in _FRAME_PARTS.items())])
    return d.groupBy(*group).applyInPandas(run, schema)


_FRAME_PARTS = {
    "component": "int", "part": "int", "split_role": "string", "freq_start": "int", "freq_stop": "int", "time_start": "int", "time_stop": "int", "filled_area": "long", "score_mean": "double", "score_peak": "double", "density": "double",
    "failed_reasons": "array<string>", "keep": "boolean", "failed_reason": "string",
}
