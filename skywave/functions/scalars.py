"""Column expressions: decibels, clipping, gates, names, frame arithmetic. Nulls stay null unless a docstring says more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decibel floors of the inputs.
POWER_FLOOR = 1e-12
LINEAR_FLOOR = 1e-20
PSD_FLOOR = 1e-10


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, lo), hi))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def complex_db(re: Column, im: Column) -> Column:
    """Power of a complex value in dB, at least -120."""
    return 10 * F.log10(F.greatest(re * re + im * im, F.lit(POWER_FLOOR)))


def from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def to_db(x: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(LINEAR_FLOOR)))


def relative_db(power: Column, floor: Column, low: float = -5.0, high: float = 25.0) -> Column:
    """Linear power over a linear floor, in dB, clipped."""
    return clip(10 * F.log10(F.greatest(power, F.lit(LINEAR_FLOOR)) / F.greatest(floor, F.lit(LINEAR_FLOOR))), low, high)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def bounded_window(total: Column, target: Column, centre_fraction: Column) -> Column:
    """(start, stop) of a slice of `target` of `total` rows around a centre; all rows when the target is not smaller."""
    start = F.greatest(F.lit(0), F.least(half_even(total * centre_fraction) - F.floor(target / 2), total - target))
    whole = target >= total
    return F.struct(F.when(whole, 0).otherwise(start).cast("long").alias("start"), F.when(whole, total).otherwise(start + target).cast("long").alias("stop"))


def samples_for_frames(frames: Column, nfft: int, overlap: int) -> Column:
    """Samples that so many spectrogram columns cover."""
    hop = nfft - overlap
    if hop <= 0:
        raise ValueError("the overlap must be smaller than the transform")
    return nfft + (frames - 1) * hop


def scaled_overlap(overlap: int, nfft: int, new_nfft: Column) -> Column:
    """The overlap in the same proportion for another transform size."""
    return F.least(F.greatest(half_even(new_nfft * F.lit(overlap / nfft)), F.lit(0)), new_nfft - 1)


def sigmf_type(datatype: Column) -> Column:
    """(complex, kind, bits, bytes, endian) of a SigMF datatype such as ci16_le; null when it is none."""
    pattern = r"^(c|r)?([iuf])(8|16|32|64)(_le|_be)?$"
    part = lambda k: F.regexp_extract(datatype, pattern, k)
    ok = datatype.rlike(pattern)
    return F.when(
        ok,
        F.struct(
            (part(1) == "c").alias("complex"), part(2).alias("kind"), part(3).cast("int").alias("bits"), (part(3).cast("int") / 8).cast("int").alias("bytes"), F.when(part(4) == "_be", "be").otherwise("le").alias("endian")
        ),
    )


def input_kind(path: Column, explicit: str = "auto") -> Column:
    """pgm, tensor_npy or sigmf by the path's ending; null when it has none of them. A kind given explicitly wins."""
    if explicit != "auto":
        return F.lit("tensor_npy" if explicit == "npy" else explicit)
    low = F.lower(path)
    return F.when(low.endswith(".pgm"), "pgm").when(low.endswith(".npy"), "tensor_npy").when(low.endswith(".sigmf-meta"), "sigmf")


def snapshot_name(path: Column) -> Column:
    """(channel, epoch_ms, time_bins, freq_bins) in a snapshot's file name; null when it has none."""
    pattern = r"_ch(\d+)_(\d+)_(\d+)x(\d+)\.pgm$"
    part = lambda k: F.regexp_extract(path, pattern, k)
    return F.when(path.rlike(pattern), F.struct(part(1).cast("int").alias("channel"), part(2).cast("long").alias("epoch_ms"), part(3).cast("int").alias("time_bins"), part(4).cast("int").alias("freq_bins")))


def calibrated(flag: Column, sample_rate_hz: Column) -> Column:
    """Whether a frequency axis is in Hz: the flag if there is one, else that a sample rate is known."""
    return F.coalesce(flag, sample_rate_hz > 0, F.lit(False))


def offset_frequency(freq: Column, centre: Column, sample_rate_hz: Column) -> Column:
    """An absolute frequency as an offset from the centre; what is small enough already stays."""
    return F.when(F.abs(freq) > 2 * sample_rate_hz, freq - centre).otherwise(freq)


def chunk_blend_weight(row: Column, rows: Column) -> Column:
    """Weight of a row (from 0) in a chunk of `rows`: a raised Hann window, 1 for chunks of two rows or fewer."""
    n = rows - 1
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * row / n)
    # the symmetric window peaks in the middle, between two rows when their number is even
    peak = F.when(rows % 2 == 1, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(2 * F.pi() * F.floor(n / 2) / n))
    return F.when(rows <= 2, F.lit(1.0)).otherwise(0.2 + 0.8 * hann / peak)
