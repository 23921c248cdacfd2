"""Spectrograms from samples, noise levels, and the per-tile detector."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywave.config import CoherentPower
from skywave.kernels.arrays import power_spectra, resize_bilinear, structure_gate


def segments(samples: DataFrame, nfft: int, overlap: int, group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """(group, seg, pos, i, q): every sample in each sliding segment that holds it; a short last segment is dropped."""
    hop = nfft - overlap
    if hop <= 0:
        raise ValueError("the overlap must be smaller than the transform")
    n = samples.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg((F.max("n") + 1).alias("_n"))
    on = F.lit(True)
    for g in group:
        on = on & (samples[g] == F.col(f"_{g}"))
    d = samples.join(n, on)
    last = F.floor((F.col("_n") - nfft) / hop)
    first, final = F.greatest(F.lit(0), F.ceil((F.col("n") - nfft + 1) / hop)), F.least(F.floor(F.col("n") / hop), last)
    d = d.where(final >= first).withColumn("seg", F.explode(F.sequence(first, final)))
    return d.select(*group, "seg", (F.col("n") - F.col("seg") * hop).alias("pos"), "i", "q")


def spectrogram(samples: DataFrame, sample_rate: float, nfft: int = 1024, overlap: int = 512, magnitude: bool = False, group: Sequence[str] = ("capture_id",), segments_a_task: int = 256) -> DataFrame:
    """(group, seg, f, time_s, power_db) of samples (group, n, i, q): windowed transforms of sliding segments.

    Segments are grouped by the hundred, so one task transforms a batch of bounded size.
    """
    segs = segments(samples, nfft, overlap, group).withColumn("_b", F.floor(F.col("seg") / segments_a_task))
    hop = nfft - overlap

    def transform(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["seg", "pos"])
        number = t["seg"].to_numpy().reshape(-1, nfft)[:, 0]
        db = power_spectra((t["i"].to_numpy() + 1j * t["q"].to_numpy()).reshape(-1, nfft), sample_rate, magnitude)
        out = pd.DataFrame({"seg": np.repeat(number, nfft), "f": np.tile(np.arange(nfft, dtype=np.int32), len(number)), "power_db": db.ravel()})
        for g in group:
            out[g] = t[g].iloc[0]
        out["time_s"] = (nfft / 2 + out["seg"] * hop) / sample_rate
        return out[[*group, "seg", "f", "time_s", "power_db"]]

    types = {f.name: f.dataType.simpleString() for f in segs.schema}
    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", seg long, f int, time_s double, power_db double"
    return segs.groupBy(*group, "_b").applyInPandas(transform, schema)


def signal_to_noise(samples: DataFrame, floors: DataFrame, group: str = "capture_id") -> DataFrame:
    """(group, p_total, p_noise, p_signal, snr_db) from samples and a noise floor in dB."""
    p = samples.groupBy(group).agg(F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q")).alias("p_total"))
    f = floors.select(F.col(group).alias("_g"), F.pow(F.lit(10.0), F.col("noise_floor_db") / 10).alias("p_noise"))
    d = p.join(f, p[group] == f._g).drop("_g").withColumn("p_signal", F.greatest(F.col("p_total") - F.col("p_noise"), F.lit(1e-20)))
    return d.withColumn("snr_db", 10 * F.log10(F.col("p_signal") / F.greatest(F.col("p_noise"), F.lit(1e-20))))


def noise_plan(power: DataFrame, levels: Sequence[float], group: str = "capture_id") -> DataFrame:
    """(group, target_snr_db, added_power, sigma, achieved_snr_db): the noise that brings each capture to each level."""
    snr = power.sparkSession.createDataFrame([(float(x),) for x in levels], "target_snr_db double")
    d = power.crossJoin(F.broadcast(snr))
    d = d.withColumn("added_power", F.greatest(F.col("p_signal") / F.pow(F.lit(10.0), F.col("target_snr_db") / 10) - F.col("p_noise"), F.lit(0.0)))
    return d.select(group, "target_snr_db", "added_power", F.sqrt(F.col("added_power") / 2).alias("sigma"), (10 * F.log10(F.col("p_signal") / (F.col("p_noise") + F.col("added_power")))).alias("achieved_snr_db"))


def add_noise(samples: DataFrame, plan: DataFrame, seed: int = 0, group: str = "capture_id") -> DataFrame:
    """Samples at each level of the plan, with noise that depends on seed, capture, level and sample only."""
    d = samples.join(plan.select(F.col(group).alias("_g"), "target_snr_db", "sigma"), samples[group] == F.col("_g")).drop("_g")

    def uniform(salt: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col("target_snr_db"), F.col("n"), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    radius, angle = F.sqrt(-2 * F.log(uniform(1))), 2 * F.pi() * uniform(2)
    return d.withColumn("i", F.col("i") + F.col("sigma") * radius * F.cos(angle)).withColumn("q", F.col("q") + F.col("sigma") * radius * F.sin(angle)).drop("sigma")


def tile_coherence(cells: DataFrame, scales: Sequence[float] = CoherentPower().scales, group: Sequence[str] = ("capture_id", "frame_id", "chunk_index")) -> DataFrame:
    """(group, f, t, coherence, gate) of each tile: one task holds one sub-band of one frame."""
    types = {f.name: f.dataType.simpleString() for f in cells.schema}

    def gate(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["f", "t"])
        rows, cols = p["f"].nunique(), p["t"].nunique()
        out = p[[*group, "f", "t"]].copy()
        coherence, strength = structure_gate(p["power_db"].to_numpy().reshape(rows, cols), tuple(scales))
        out["coherence"], out["gate"] = coherence.ravel(), strength.ravel()
        return out

    schema = ", ".join(f"{c} {types[c]}" for c in [*group, "f", "t"]) + ", coherence double, gate double"
    return cells.select(*group, "f", "t", "power_db").groupBy(*group).applyInPandas(gate, schema)


def bilinear_patches(df: DataFrame, column: str, out_rows: int, out_cols: int, group: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """(group, pr, pc, value): each tile's map resized."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def resize(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["f", "t"])
        x = resize_bilinear(p[column].to_numpy(float).reshape(p["f"].nunique(), p["t"].nunique()), out_rows, out_cols)
        r, c = np.divmod(np.arange(x.size), out_cols)
        return pd.DataFrame({**{g: p[g].iloc[0] for g in group}, "pr": r.astype(np.int32), "pc": c.astype(np.int32), "value": x.ravel()})

    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", pr int, pc int, value double"
    return df.select(*group, "f", "t", column).groupBy(*group).applyInPandas(resize, schema)

