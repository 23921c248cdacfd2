"""Annotations: windows, centre frequencies in force, projection onto the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.operators.boxes import covered


def window_annotations(annotations: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(capture_id, win_start, ann_id, start, stop, ...) of annotations that overlap windows of `width` samples, clipped to them.

    Windows start at multiples of the width, so an annotation meets just the windows it covers (no theta join).
    Annotations without start or count are skipped; the label is `annotation` where it is missing.
    """
    a = annotations.where("sample_start is not null and sample_count is not null and sample_count > 0").withColumn("_stop", F.col("sample_start") + F.col("sample_count"))
    a = a.withColumn("_w", F.explode(F.sequence(F.floor(F.col("sample_start") / width), F.floor((F.col("_stop") - 1) / width)))).withColumn("_w", F.col("_w") * width)
    w = windows.select(F.col("win_start"))
    j = a.join(w, a._w == w.win_start)
    return j.select(
        "capture_id", "win_start", "ann_id", F.greatest("sample_start", "win_start").alias("start"), F.least(F.col("_stop"), F.col("win_start") + width).alias("stop"),
        "freq_lower_edge", "freq_upper_edge", F.coalesce("label", F.lit("annotation")).alias("label"),
    )


#: Samples of a time bucket in which annotations look for their tune.
BUCKET = 4096


def centre_in_force(annotations: DataFrame, tunes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Annotations with the centre frequency of the last tune at or before their start, else that of the first tune.

    An as-of join by time buckets: inside a bucket both kinds of rows stand in one order and the last frequency seen so far
    is carried on; what came before a bucket is the last tune of the buckets before it, carried over one row a bucket. So no
    sort is longer than a bucket, or than the buckets of a capture.
    """
    at = F.floor(F.col("sample_start") / bucket).alias("_b")
    frequency = F.col("frequency").cast("double")
    both = annotations.select("capture_id", at, "sample_start", F.lit(1).alias("kind"), "ann_id", F.lit(None).cast("double").alias("frequency"))
    both = both.unionByName(tunes.select("capture_id", at, "sample_start", F.lit(0).alias("kind"), F.lit(None).cast(annotations.schema["ann_id"].dataType).alias("ann_id"), frequency.alias("frequency")))
    carried = F.last("frequency", ignorenulls=True).over(Window.partitionBy("capture_id", "_b").orderBy("sample_start", "kind"))
    told = both.withColumn("_inside", carried).where("kind = 1").drop("frequency")
    # the row of a bucket: its last tune, null where it has annotations only
    known = F.when(F.col("kind") == 0, F.struct("sample_start", "frequency"))
    steps = both.groupBy(F.col("capture_id").alias("_c"), F.col("_b").alias("_at")).agg(F.max(F.when(F.col("frequency").isNotNull(), known)).alias("_last"), F.min(known).alias("_first"))
    line = Window.partitionBy("_c").orderBy("_at")
    before = F.last(F.col("_last.frequency"), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumns({"_before": before, "_start": F.min("_first").over(Window.partitionBy("_c"))["frequency"]})
    j = told.join(steps, (told.capture_id == steps._c) & (told._b == steps._at), "left")
    return j.select("capture_id", "ann_id", "sample_start", F.coalesce("_inside", "_before", "_start").alias("centre_hz"))


def recentre_edges(boxes: DataFrame, axis: DataFrame) -> DataFrame:
    """Boxes given as offsets moved by the axis centre, captures with an absolute axis only.

    An axis is absolute where its centre lies beyond ten times its span (1 Hz at the least) and ten times the edges' scale
    (the 95 % quantile of their size), and that scale is below twice the span. Captures without edges or axis stay as they are.
    """
    edges = boxes.select("capture_id", F.explode(F.array("f0", "f1")).alias("e")).groupBy(F.col("capture_id").alias("_c")).agg(F.percentile(F.abs("e"), F.lit(0.95)).alias("p95"))
    spans = axis.groupBy(F.col("capture_id").alias("_a")).agg(F.greatest(F.max("freq_hz") - F.min("freq_hz"), F.lit(1.0)).alias("span"), ((F.max("freq_hz") + F.min("freq_hz")) / 2).alias("mid"))
    j = boxes.join(edges, boxes.capture_id == edges._c, "left").join(spans, boxes.capture_id == spans._a, "left")
    away = F.coalesce((F.abs("mid") > 10 * F.greatest("span", "p95")) & F.col("p95").isNotNull() & (F.col("p95") < 2 * F.col("span")), F.lit(False))
    return j.withColumns({e: F.when(away, F.col(e) + F.col("mid")).otherwise(F.col(e)) for e in ("f0", "f1")}).drop("_c", "_a", "p95", "span", "mid")


def cell_edges(axis: DataFrame, column: str, index: str, group: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """The axis with lo and hi of each cell: midpoints; the end cells are mirrored; a single cell reaches half a unit each way."""
    w = Window.partitionBy(*group).orderBy(index)
    x, before, after = F.col(column), F.lag(column).over(w), F.lead(column).over(w)
    lo = F.coalesce((before + x) / 2, x - (after - x) / 2, x - 0.5)
    hi = F.coalesce((after + x) / 2, x + (x - before) / 2, x + 0.5)
    return axis.withColumn("lo", lo).withColumn("hi", hi)


def annotation_mask(boxes: DataFrame, freq_edges: DataFrame, time_edges: DataFrame) -> DataFrame:
    """Distinct (capture_id, f, t) of cells that boxes (t0, t1, f0, f1) strictly overlap; edges in either order, null frequency edges mean all rows.

    lo and hi of the cells rise with their index from 0 on. An axis is one array beside each box, in which the box's first and
    last cell are counted; what the boxes cover comes from their corners (covered), not from their cells.
    """

    def line(edges: DataFrame, index: str, name: str) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct(index, "lo", "hi")))
        d = edges.groupBy(F.col("capture_id").alias(f"_c{name}")).agg(cells.alias(f"_{name}"))
        return d.select(f"_c{name}", F.col(f"_{name}.lo").alias(f"_lo{name}"), F.col(f"_{name}.hi").alias(f"_hi{name}"))

    rows, cols = line(freq_edges, "f", "f"), line(time_edges, "t", "t")
    b = boxes.join(rows, boxes.capture_id == rows._cf).join(cols, boxes.capture_id == cols._ct)
    count = lambda column, test: F.size(F.filter(column, test)).cast("long")
    span = lambda a, z, name: (count(f"_hi{name}", lambda x: x <= F.least(a, z)), count(f"_lo{name}", lambda x: x < F.greatest(a, z)))
    (fa, fb), (ta, tb) = span("f0", "f1", "f"), span("t0", "t1", "t")
    every = F.least("f0", "f1").isNull()
    ranges = b.select("capture_id", F.when(every, F.lit(0)).otherwise(fa).alias("fa"), F.when(every, F.size("_lof")).otherwise(fb).alias("fb"), ta.alias("ta"), tb.alias("tb"))
    grid = freq_edges.select("capture_id", "f").join(time_edges.select(F.col("capture_id").alias("_c"), "t"), F.col("capture_id") == F.col("_c")).drop("_c")
    return covered(grid, ranges).where("mask").select("capture_id", "f", "t")


def patch_mask(cells: DataFrame, rows: int, cols: int, ph: int, pw: int, least: float | None = None) -> DataFrame:
    """(capture_id, pr, pc) of patches that a set of (capture_id, f, t) cells overlaps, or covers to at least a share.

    Patch k of p over n cells spans floor(k*n/p) to floor((k+1)*n/p), one cell at the least.
    """
    spark = cells.sparkSession

    def bounds(n: int, p: int, name: str) -> DataFrame:
        k = spark.range(p).withColumn(f"{name}a", F.floor(F.col("id") * n / p))
        return k.select(F.col("id").cast("int").alias(name), f"{name}a", F.greatest(F.floor((F.col("id") + 1) * n / p), F.col(f"{name}a") + 1).alias(f"{name}b"))

    r, c = bounds(rows, ph, "pr"), bounds(cols, pw, "pc")
    j = cells.join(F.broadcast(r), (F.col("f") >= F.col("pra")) & (F.col("f") < F.col("prb"))).join(F.broadcast(c), (F.col("t") >= F.col("pca")) & (F.col("t") < F.col("pcb")))
    covered = j.groupBy("capture_id", "pr", "pc").agg((F.count("*") / F.first((F.col("prb") - F.col("pra")) * (F.col("pcb") - F.col("pca")))).alias("coverage"))
    return covered if least is None else covered.where(F.col("coverage") >= least)


def default_windows(annotations: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(capture_id, start): where a capture none of whose windows meets an annotation looks instead: a quarter window before its first one."""
    met = window_annotations(annotations, windows, width).select("capture_id").distinct()
    first = annotations.where("sample_start is not null").groupBy("capture_id").agg(F.min("sample_start").alias("s"))
    return first.join(met, "capture_id", "left_anti").select("capture_id", F.greatest(F.lit(0), F.col("s") - F.lit(width // 4)).alias("start"))
