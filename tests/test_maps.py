"""Maps as wholes: the grey map, cleaned masks and rectangles, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bands import parts_of
from test_signal import back, grid
from test_whole_band import bell, filtered, norm, smoother

from skywave.operators import windows as wn
from skywave.operators.fusion import clean_mask


@pytest.mark.parametrize("flat", [False, True])
def test_grey_map_against_a_plain_version(spark, flat):
    x = np.random.default_rng(1).normal(0, 2, (40, 36)) + np.add.outer(np.linspace(0, 20, 40), np.linspace(0, 5, 36))
    if flat:
        x = np.add.outer(np.linspace(0, 20, 40), np.zeros(36))
    trend = (smoother(40, bell(max(1, 40 / 32))[0]) @ x.mean(1))[:, None] + (smoother(36, bell(max(1, 36 / 32))[0]) @ x.mean(0))[None] - x.mean()
    stands = x - trend
    dev = stands - filtered(stands, np.ones(7) / 7, np.ones(7) / 7)
    z = dev / np.maximum(np.sqrt(filtered(dev**2, np.ones(9) / 9, np.ones(9) / 9) + 1e-6), 1e-4)
    signed = np.clip(0.5 + 0.5 * z / max(np.quantile(np.abs(z), 0.95), 1e-6), 0, 1)
    mix = 0.7 * signed + 0.3 * norm(stands, 2, 98)
    if mix.std() < 0.02:
        mix = norm(stands, 1, 99)
    got = back(wn.signal_agnostic_map(grid(spark, x), 40, 36), "grey", x.shape).astype(float)
    assert np.abs(got - np.clip(np.round(255 * mix), 0, 255)).max() <= (1 if flat else 0)


def moved(m, offsets, fold):
    """fold over the cells at the offsets; outside is false."""
    h, w = m.shape
    return np.array([[fold(0 <= i + a < h and 0 <= j + b < w and bool(m[i + a, j + b]) for a, b in offsets) for j in range(w)] for i in range(h)])


def square(n, back_first):
    reach = range(-(n // 2), (n - 1) // 2 + 1) if back_first else range(-((n - 1) // 2), n // 2 + 1)
    return [(a, b) for a in reach for b in reach]


@pytest.mark.parametrize("conservative", [False, True])
def test_cleaned_mask_against_a_plain_version(spark, conservative):
    rng = np.random.default_rng(3)
    m = rng.random((30, 34)) < 0.55
    m[8:20, 6:22] = True
    m[12:15, 10:13] = False  # a hole
    grow, shrink = (lambda x, n: moved(x, square(n, True), any)), (lambda x, n: moved(x, square(n, False), all))
    opened = grow(shrink(m, 2), 2)
    n = 2 if conservative else 3
    want = shrink(grow(opened, n), n)
    if not conservative:
        for p in parts_of(~want):
            if all(0 < i < 29 and 0 < j < 33 for i, j in p):
                want[tuple(np.array(p).T)] = True
    least = max(4, int((0.0025 if conservative else 0.003) * m.size))
    for p in parts_of(want):
        if len(p) < least:
            want[tuple(np.array(p).T)] = False
    got = back(clean_mask(grid(spark, m, "m").withColumn("m", F.col("m").cast("boolean")), "m", "k", m.size, conservative), "k", m.shape).astype(bool)
    assert (got == want).all() and want.any()


def test_power_seeds_with_valid_rows(spark):
    x = np.random.default_rng(5).normal(0, 3, (24, 40))
    x[8:12] += 15
    lin = 10 ** (x / 10)
    rel = np.clip(10 * np.log10(lin / np.quantile(lin[4:], 0.3)), -5, 25)
    up = np.maximum(rel - filtered(rel, np.ones(9) / 9, np.ones(33) / 33), 0)
    up[:4] = 0
    mean = lambda a, b: filtered(up, np.ones(a) / a, np.ones(b) / b)
    want = 0.65 * norm(mean(1, 7), 5, 95) + 0.35 * norm(np.maximum(up - mean(5, 5), 0), 5, 95)
    assert np.allclose(back(wn.power_seeds(grid(spark, x), local=True, valid=F.col("f") >= 4), "seed", x.shape).astype(float), want)


def test_narrowed_quantiles_equal_percentile(spark):
    from skywave.functions.quantiles import narrowed_quantiles

    d = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS g", "CASE WHEN id % 3 = 1 THEN double(id div 900) WHEN id % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 51 = 0 THEN NULL ELSE pow(sin(double(id)), 7) * 1e6 END AS v"
    ).union(spark.sql("SELECT 'one', 3.5D UNION ALL SELECT 'none', NULL UNION ALL SELECT 'two', 1.0D UNION ALL SELECT 'two', 2.0D"))  # ties, nulls, a null group, one value
    qs = (0.0, 0.05, 0.5, 0.951, 1.0)
    want = {r.g: r.p for r in d.where("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("p")).collect()}
    for bins, few in ((1024, 10_000), (7, 5)):
        got = {r.g: r.quantiles for r in narrowed_quantiles(d, "v", qs, ("g",), bins, few).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)


def test_narrowed_quantiles_of_values_that_change_in_their_last_bits(spark):
    """As sums of doubles do that Spark adds in another order each time it makes them."""
    from skywave.functions.quantiles import narrowed_quantiles

    def shaken(batches):
        for p in batches:
            yield p.assign(v=np.nextafter(p["v"], np.random.default_rng().choice([-np.inf, np.inf], len(p))))

    x = np.sin(np.arange(3000)) * 50
    d = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)], "g long, v double").mapInPandas(shaken, "g long, v double")
    qs = (0.0, 0.05, 0.3, 0.95, 1.0)
    for _ in range(2):
        got = {r.g: r.quantiles for r in narrowed_quantiles(d, "v", qs, ("g",), 7, 5).collect()}
        assert all(np.allclose(got[g], np.quantile(x[g::3], qs), rtol=0, atol=1e-9) for g in range(3))
