"""Front-end correction, side bands and sub-band plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.config import Chunking, FrontEnd
from skywave.functions.quantiles import with_scalars
from skywave.functions.scalars import half_even
from skywave.operators.windows import convolve_axis, gaussian_kernel


def valid_rows(axis: DataFrame, percent: float = 0.0, hz: float = 0.0, min_keep: int = 16, calibrated: bool = True, group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """The axis (group, f, freq_hz) with `valid`: false for the rows that the side bands at both ends take.

    A share wins over a width in Hz; widths count only on calibrated axes; at least min_keep rows stay.
    """
    percent = min(max(percent, 0.0), 0.49)
    line = Window.partitionBy(*group).orderBy("freq_hz")
    d = axis.withColumn("_step", F.abs(F.col("freq_hz") - F.lag("freq_hz").over(line)))
    d = with_scalars(d, group, _bin=F.percentile("_step", F.lit(0.5)), _n=F.count("*"))
    if percent > 0:
        bins = F.ceil(F.col("_n") * F.lit(percent))
    elif hz > 0 and calibrated:
        bins = F.ceil(F.lit(float(hz)) / F.col("_bin"))
    else:
        bins = F.lit(0)
    d = d.withColumn("_bins", F.greatest(F.lit(0), F.least(bins, F.floor((F.col("_n") - min_keep) / 2))))
    rank = F.row_number().over(line)
    return d.withColumn("valid", (rank > F.col("_bins")) & (rank <= F.col("_n") - F.col("_bins"))).drop("_step", "_bin", "_n", "_bins")


def row_profile(cells: DataFrame, settings: FrontEnd = FrontEnd(), valid: DataFrame | None = None, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """(group, f, row_floor_db, response_db, boost_db): what each row lacks against the best of the valid rows.

    valid has (capture_id, f, valid); without it all rows are valid. A row is never lowered.
    """
    floors = cells.groupBy(*group, "f").agg(F.percentile("power_db", F.lit(settings.row_quantile)).alias("row_floor_db"))
    smooth = convolve_axis(floors, "row_floor_db", "response_db", "f", gaussian_kernel(max(1.0, settings.smooth_sigma)), group=group, line_key=())
    if valid is not None:
        v = valid.select(F.col("capture_id").alias("_c"), F.col("f").alias("_f"), "valid")
        smooth = smooth.join(v, (smooth.capture_id == v._c) & (smooth.f == v._f), "left").drop("_c", "_f")
    else:
        smooth = smooth.withColumn("valid", F.lit(True))
    d = with_scalars(smooth, group, _ref=F.percentile(F.when(F.col("valid"), F.col("response_db")), F.lit(settings.reference_quantile)))
    boost = F.least(F.greatest(F.col("_ref") - F.col("response_db"), F.lit(0.0)), F.lit(settings.max_boost_db))
    return d.select(*group, "f", "row_floor_db", "response_db", boost.alias("boost_db"))


def correct_frontend(cells: DataFrame, profile: DataFrame, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """Cells with each row's boost added."""
    p = profile.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), "boost_db")
    on = cells.f == F.col("_f")
    for g in group:
        on = on & (cells[g] == F.col(f"_{g}"))
    return cells.join(p, on).withColumn("power_db", F.col("power_db") + F.col("boost_db")).drop("_f", "boost_db", *[f"_{g}" for g in group])


def plan_chunks(axis: DataFrame, settings: Chunking = Chunking(), group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """(group, chunk_index, row_start, row_stop, freq_start_hz, freq_stop_hz) of overlapping sub-bands; rows are half open.

    Sub-bands of a width in Hz, both ends inclusive and compared in single precision; a band that covers everything makes
    the plan go by shares of the valid rows instead. axis has (group, f, freq_hz, valid).
    """
    if settings.overlap_hz >= settings.bandwidth_hz:
        raise ValueError("the overlap must be smaller than the band")
    rows = axis.where("valid")
    spans = rows.groupBy(*group).agg(F.min("freq_hz").alias("lo"), F.max("freq_hz").alias("hi"), F.count("*").alias("n"), F.min("f").alias("first"))
    bw, step = float(settings.bandwidth_hz), float(settings.bandwidth_hz - settings.overlap_hz)

    wide = spans.where(F.col("hi") - F.col("lo") > bw)
    starts = wide.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("hi") - F.col("lo")) / step))))
    starts = starts.withColumn("start", F.col("lo") + F.col("i") * step).withColumn("stop", F.least(F.col("start") + bw, F.col("hi")))
    # the plan ends with the first band that reaches the top
    starts = starts.where((F.col("i") == 0) | (F.col("lo") + (F.col("i") - 1) * step + bw < F.col("hi"))).select(*[F.col(g).alias(f"_{g}") for g in group], "i", "start", "stop")
    on = (F.col("freq_hz").cast("float") >= F.col("start").cast("float")) & (F.col("freq_hz").cast("float") <= F.col("stop").cast("float"))
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    by_hz = rows.join(starts, on).groupBy(*group, "i").agg(F.min("f").alias("row_start"), (F.max("f") + 1).alias("row_stop"), F.min("freq_hz").alias("freq_start_hz"), F.max("freq_hz").alias("freq_stop_hz"), F.count("*").alias("rows"))
    by_hz = by_hz.where(F.col("rows") >= settings.min_rows)

    share = min(max(settings.fraction, 0.10), 1.0)
    small = spans.where(F.col("hi") - F.col("lo") <= bw)
    size = F.least(F.greatest(half_even(F.col("n") * share), F.least(F.lit(settings.min_rows), F.col("n"))), F.col("n"))
    small = small.withColumn("size", size).withColumn("back", F.least(F.greatest(half_even(F.col("size") * settings.overlap_fraction), F.lit(0)), F.col("size") - 1))
    small = small.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(F.col("n") - F.col("size"), F.lit(0)) / (F.col("size") - F.col("back"))))))
    small = small.withColumn("a", F.col("i") * (F.col("size") - F.col("back"))).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("n"))).select(*[F.col(g).alias(f"_{g}") for g in group], "i", "a", "b")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("f")) - 1)
    on = (F.col("_r") >= F.col("a")) & (F.col("_r") < F.col("b"))
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    by_share = ranked.join(small, on).groupBy(*group, "i").agg(F.min("f").alias("row_start"), (F.max("f") + 1).alias("row_stop"), F.min("freq_hz").alias("freq_start_hz"), F.max("freq_hz").alias("freq_stop_hz"), F.count("*").alias("rows"))
    both = by_hz.unionByName(by_share)
    return both.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(*group).orderBy("i")) - 1).cast("int")).select(*group, "chunk_index", "row_start", "row_stop", "freq_start_hz", "freq_stop_hz")


def assign_chunks(cells: DataFrame, chunks: DataFrame, group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """A row for each cell and sub-band that holds it (a range join on the small plan)."""
    c = chunks.select(*[F.col(g).alias(f"_{g}") for g in group], "chunk_index", "row_start", "row_stop")
    on = (F.col("f") >= F.col("row_start")) & (F.col("f") < F.col("row_stop"))
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return cells.join(c, on).drop(*[f"_{g}" for g in group])


def adapt_chunking(captures: DataFrame, target_rows: int = 1024, overlap_rows: int = 256) -> DataFrame:
    """Captures (kind, rows, bin_hz) with bandwidth_hz and overlap_hz in whole rows for tensors; null for other kinds."""
    rows = F.least(F.greatest(F.lit(target_rows), F.lit(32)), F.col("rows"))
    overlap = F.least(F.lit(overlap_rows), rows - 1)
    tensor = F.col("kind") == "tensor_npy"
    return captures.withColumn("bandwidth_hz", F.when(tensor, rows * F.col("bin_hz"))).withColumn("overlap_hz", F.when(tensor, overlap * F.col("bin_hz")))


def uniform_trim(spans: DataFrame, rows: Column, step: Column, most: Column) -> DataFrame:
    """The least extra trim at which the rows left divide into equal overlapping chunks; null where none does."""
    t = spans.withColumn("trim", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    ok = (F.col("n") - 2 * F.col("trim") >= rows) & (F.pmod(F.col("n") - 2 * F.col("trim") - rows, step) == 0)
    return t.groupBy("capture_id").agg(F.min(F.when(ok, F.col("trim"))).alias("trim"))
