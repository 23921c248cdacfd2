"""Patch grids over cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywave.functions.quantiles import with_scalars


def patch_mean(df: DataFrame, column: str, rows: int, cols: int, ph: int, pw: int, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """(group, pr, pc, value): means over blocks of whole cells; what is left over at the ends is cut off."""
    bh, bw = max(1, rows // ph), max(1, cols // pw)
    d = df.where((F.col("f") < bh * ph) & (F.col("t") < bw * pw)).withColumn("pr", F.floor(F.col("f") / bh).cast("int")).withColumn("pc", F.floor(F.col("t") / bw).cast("int"))
    return d.groupBy(*group, "pr", "pc").agg(F.avg(column).alias("value"))


def nearest_resize(df: DataFrame, column: str, rows: int, cols: int, out_rows: int, out_cols: int, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """(group, pr, pc, value): the nearest cell, grid corners aligned (rounding halves to even)."""
    spark = df.sparkSession

    def index(n: int, p: int, name: str, source: str) -> DataFrame:
        at = F.bround(F.col("id") * (n - 1) / max(p - 1, 1), 0).cast("int")
        return spark.range(p).select(F.col("id").cast("int").alias(name), at.alias(source))

    r, c = index(rows, out_rows, "pr", "_f"), index(cols, out_cols, "pc", "_t")
    return df.join(F.broadcast(r), F.col("f") == F.col("_f")).join(F.broadcast(c), F.col("t") == F.col("_t")).select(*group, "pr", "pc", F.col(column).alias("value"))


def zoom(df: DataFrame, column: str, rows: int, cols: int, out_rows: int, out_cols: int, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """(group, pr, pc, value): linear between the nearest cells of each axis, grid corners aligned, no averaging."""
    spark = df.sparkSession

    def parts(n: int, p: int, name: str, source: str, weight: str) -> DataFrame:
        at = F.col("id") * (n - 1) / max(p - 1, 1)
        ends = F.array_distinct(F.array(F.floor(at), F.least(F.floor(at) + 1, F.lit(n - 1))))
        d = spark.range(p).select(F.col("id").cast("int").alias(name), F.explode(ends).alias("_end"), at.alias("_at"))
        return d.select(name, F.col("_end").cast("int").alias(source), (1 - F.abs(F.col("_at") - F.col("_end"))).alias(weight))

    r, c = parts(rows, out_rows, "pr", "_f", "_wf"), parts(cols, out_cols, "pc", "_t", "_wt")  # at most two rows for each row and column of the result
    d = df.join(F.broadcast(r), F.col("f") == F.col("_f")).join(F.broadcast(c), F.col("t") == F.col("_t"))
    return d.groupBy(*group, "pr", "pc").agg(F.sum(F.col("_wf") * F.col("_wt") * F.col(column)).alias("value"))


def spread_rows(df: DataFrame, profile: DataFrame, column: str, group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """The cells with the value that profile(group, f, column) gives their row, numbers and masks alike; null where it gives none."""
    p = profile.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), F.col(column))
    on = df["f"] == F.col("_f")
    for g in group:
        on = on & (df[g] == F.col(f"_{g}"))
    return df.join(p, on, "left").drop("_f", *[f"_{g}" for g in group])


def patch_pixels(df: DataFrame, column: str, rows: int, cols: int, ph: int, pw: int, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """(group, node, pr, pc, x): the cells of each patch as one vector, row by row; what is left over at the ends is cut off."""
    bh, bw = max(1, rows // ph), max(1, cols // pw)
    d = df.where((F.col("f") < bh * ph) & (F.col("t") < bw * pw)).withColumn("pr", F.floor(F.col("f") / bh).cast("int")).withColumn("pc", F.floor(F.col("t") / bw).cast("int"))
    d = d.groupBy(*group, "pr", "pc").agg(F.array_sort(F.collect_list(F.struct("f", "t", F.col(column).cast("double").alias("v")))).alias("_cells"))
    return d.select(*group, (F.col("pr") * pw + F.col("pc")).cast("long").alias("node"), "pr", "pc", F.col("_cells.v").alias("x"))


def spread_patches(df: DataFrame, maps: DataFrame, column: str, out: str, rows: str = "bilinear", cols: str = "nearest", group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """The cells with the value of a patch map (group, pr, pc, column) resized to them, pixel centres aligned.

    Each axis is `nearest` or `bilinear`; a bilinear axis that shrinks widens its triangle. The default keeps time sharp.
    Cells are numbered from the least f and t of their group, so sub-bands need not start at row 0. A group's map is one
    array beside its cells; cells of groups without a map go.
    """
    grids = maps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pr", "pc", F.col(column).cast("double").alias("v")))).alias("_cells"), (F.max("pr") + 1).alias("_ph"), (F.max("pc") + 1).alias("_pw"))
    grids = grids.select(*group, F.col("_cells.v").alias("_map"), "_ph", "_pw")
    d = with_scalars(df, group, _f0=F.min("f"), _t0=F.min("t"), _fn=F.max("f") - F.min("f") + 1, _tn=F.max("t") - F.min("t") + 1).join(grids, list(group))

    def taps(i: Column, size: Column, patches: Column, mode: str) -> Column:
        """(index, weight) of the patches that a cell takes its value from; the weights sum to 1."""
        at = (i + 0.5) * patches / size
        if mode == "nearest":
            return F.array(F.struct(F.least(F.floor(at), patches - 1).cast("int").alias("i"), F.lit(1.0).alias("w")))
        reach = F.greatest(patches / size, F.lit(1.0))
        near = F.sequence(F.greatest(F.floor(at - reach), F.lit(0)).cast("int"), F.least(F.ceil(at + reach), patches - 1).cast("int"))
        found = F.transform(near, lambda k: F.struct(k.alias("i"), F.greatest(1 - F.abs(k + 0.5 - at) / reach, F.lit(0.0)).alias("w")))
        whole = F.aggregate(found, F.lit(0.0), lambda s, k: s + k["w"])
        return F.transform(found, lambda k: F.struct(k["i"].alias("i"), (k["w"] / whole).alias("w")))

    d = d.withColumn("_r", taps(F.col("f") - F.col("_f0"), F.col("_fn"), F.col("_ph"), rows)).withColumn("_c", taps(F.col("t") - F.col("_t0"), F.col("_tn"), F.col("_pw"), cols))
    row = lambda r: F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["w"] * F.get(F.col("_map"), (r["i"] * F.col("_pw") + c["i"]).cast("int")))
    value = F.aggregate("_r", F.lit(0.0), lambda s, r: s + r["w"] * row(r))
    return d.withColumn(out, value).drop("_f0", "_t0", "_fn", "_tn", "_map", "_ph", "_pw", "_r", "_c")
