"""Approximate nearest neighbours by multi-index hashing.

Vectors get 64-bit codes: signs after a learned rotation (principal axes, then iterative quantisation), learned on a
bounded sample. A code splits into substrings, each indexed by its value. Two codes within Hamming radius
substrings * (radius + 1) - 1 agree in some substring up to `radius` bits, so probing all values of each substring within
that radius meets every such code. The radius is set on the sample, so that the wanted share of true neighbours lies
within the Hamming radius. What probes meet is reranked by cosine on the original vectors, in double precision. Queries
that met fewer than k vectors are probed again at the next radius, up to SCAN_FROM; those that are still short are held
against all vectors.

Every vector is indexed. Substrings have 8 bits, and 16 from WIDE_FROM vectors on, so that buckets do not grow with the table.
Buckets that hold many rows are split by salts, and each keeps its own best k for each query: of equal vectors the smallest
ids, and all that lie within TIE of the k-th. Scores are sums in one fixed order, so equal vectors score alike wherever they
are met; scores that agree to 12 digits are ties, and ties go to the smaller id.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null ids, take no part, however many
they are; a row is no candidate for the query with its own id; of rows with one id the nearest counts; vectors of another
length than most of the sample take no part; extra columns are ignored; a table without usable vectors gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .vectors import matrix, units, vectors

SUBSTRINGS = 8
#: Vectors from which on substrings have 16 bits instead of 8.
WIDE_FROM = 1 << 18
#: Scores this close to the k-th of a block of products are kept until they are added up in one order.
TIE = 1e-12
#: Vectors that the rotation and the radius are learned on, about (bound of the sample).
SAMPLE = 4000
RECALL = 0.97
#: From this radius on, probing all substrings meets more rows than there are.
SCAN_FROM = 3
#: Rows of a bucket in one task.
SALT_ROWS = 5000


def learn_rotation(x: np.ndarray, bits: int = SUBSTRINGS * 8, rounds: int = 30, seed: int = 4) -> np.ndarray:
    """A matrix whose products' signs are the code: principal axes turned so that signs keep the most of the vectors."""
    rng = np.random.default_rng(seed)
    turned = []
    while sum(t.shape[1] for t in turned) < bits:
        take = min(bits - sum(t.shape[1] for t in turned), x.shape[1])
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        axes = axes[:take].T
        take = axes.shape[1]
        low = x @ axes
        r = np.linalg.qr(rng.normal(size=(take, take)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(low @ r >= 0, 1.0, -1.0).T @ low)
            r = (u @ w).T
        turned.append(axes @ r)
    return np.concatenate(turned, 1)


def codes_of(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """A row of substring values for each vector; the rotation has 8 or 16 columns for each substring."""
    packed = np.packbits(x @ rotation >= 0, axis=1)
    return packed if rotation.shape[1] == SUBSTRINGS * 8 else packed.view(np.uint16)


def radius_for(x: np.ndarray, rotation: np.ndarray, k: int, recall: float, queries: int = 300) -> int:
    """The least substring radius that reaches the wanted share of the sample's true neighbours (whole data has nearer ones)."""
    n, bits = len(x), rotation.shape[1] // SUBSTRINGS
    if n < 2:
        return bits
    q = np.sort(np.random.default_rng(5).permutation(n)[:queries])  # ids may follow clusters
    sims = x[q] @ x.T
    sims[np.arange(len(q)), q] = -2
    top = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, n - 1)]
    code = codes_of(x, rotation)
    far = np.bitwise_count(code[q][:, None, :] ^ code[top]).sum(2)
    need = int(np.quantile(far, recall, method="higher"))
    return min(bits, max(0, -(-(need + 1) // SUBSTRINGS) - 1))


def _encode(rotation: np.ndarray):
    def run(batches):
        for batch in batches:
            keep = np.flatnonzero(np.asarray(batch.column(1).value_lengths()) == len(rotation))
            b = batch.take(pa.array(keep))
            code = codes_of(units(matrix(b.column(1))), rotation).astype(np.int32) if len(keep) else np.empty((0, SUBSTRINGS), np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, SUBSTRINGS), pa.int32()), pa.array(code.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), parts], names=["vec_id", "x", "code"])

    return run


def few_of_each(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each group of equal vectors (one may be the query's own)."""
    _, same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    i, s = ids[order], same[order]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])))
    order, s = order[new], s[new]
    return order[np.arange(len(s)) - np.searchsorted(s, s) <= k]


def _search(k: int, radius: int):
    most = SUBSTRINGS * (radius + 1) - 1

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if rows.num_rows and queries.num_rows:
            qids = queries.column("query_id").to_numpy()
            x, q = units(matrix(rows.column("x"))), units(matrix(queries.column("qx")))
            keep = few_of_each(rows.column("vec_id").to_numpy(), x, k)
            ids, x = rows.column("vec_id").to_numpy()[keep], x[keep]
            code, qcode = (matrix(c).astype(np.uint16) for c in (rows.column("code"), queries.column("qcode")))
            code = code[keep]
            for a in range(0, len(q), 512):
                sims = q[a : a + 512] @ x.T
                far = sum(np.bitwise_count(qcode[a : a + 512, j, None] ^ code[None, :, j]).astype(np.int16) for j in range(SUBSTRINGS))
                sims[(far > most) | (qids[a : a + 512, None] == ids[None])] = -2
                take = min(k, len(ids))
                kth = -np.partition(-sims, take - 1, axis=1)[:, take - 1]
                i, j = np.nonzero((sims >= kth[:, None] - TIE) & (sims > -2))
                out_q.append(qids[a + i])
                out_v.append(ids[j])
                out_s.append((q[a + i] * x[j]).sum(1))
        cat = lambda c, t: pa.array(np.concatenate(c) if c else [], t)
        return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_v, pa.int64()), "score": cat(out_s, pa.float64())})

    return run


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 50, k: int = 5, recall: float = RECALL, radius: int | None = None, wide_from: int = WIDE_FROM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every query, a row whose id is divisible by `every`."""
    valid = vectors(df, id_col, vector_col)
    many = valid.count()
    share = min(1.0, SAMPLE / max(1, many))
    # few rows under one id may all miss the share; then any will do
    picked = valid.where(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).limit(2 * SAMPLE).collect() or valid.limit(SAMPLE).collect()
    if not picked:
        return valid.where("1 = 0").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    length = np.bincount([len(r["x"]) for r in picked]).argmax()
    sample = units(np.array([r["x"] for r in sorted(picked, key=lambda r: r["vec_id"]) if len(r["x"]) == length], float))
    bits = 16 if many >= wide_from else 8
    rotation = learn_rotation(sample, SUBSTRINGS * bits)
    radius = radius_for(sample, rotation, k, recall) if radius is None else radius

    coded = stored(valid.mapInArrow(_encode(rotation), "vec_id long, x array<double>, code array<int>"), "ann-codes")
    indexed = coded.select("vec_id", "x", "code", F.posexplode("code").alias("part", "value"))
    # a count for each value of each substring: SUBSTRINGS * 2**16 rows at most
    salts = indexed.groupBy("part", "value").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).withColumnsRenamed({"part": "sp", "value": "sv"})
    index = indexed.join(F.broadcast(salts), (F.col("part") == F.col("sp")) & (F.col("value") == F.col("sv"))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    blocks = 1 + coded.count() // SALT_ROWS
    everything = coded.select(F.lit(0).alias("part"), F.lit(0).alias("value"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("salt"), "vec_id", "x", "code")

    def nearest(asking: DataFrame, within: int) -> DataFrame:
        if within < bits:
            masks = F.array(*[F.lit(m) for m in range(1 << bits) if m.bit_count() <= within])
            probes = asking.select("query_id", "qx", "qcode", F.posexplode("qcode").alias("qpart", "at"))
            probes = probes.withColumn("qvalue", F.explode(F.transform(masks, lambda m: F.col("at").bitwiseXOR(m))))
            probes = probes.join(F.broadcast(salts), (F.col("qpart") == F.col("sp")) & (F.col("qvalue") == F.col("sv")))
            rows = index.select("part", "value", "salt", "vec_id", "x", "code")
        else:
            probes, rows = asking.select("query_id", "qx", "qcode", F.lit(0).alias("qpart"), F.lit(0).alias("qvalue"), F.lit(blocks).alias("salts")), everything
        probes = probes.withColumn("qsalt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("query_id", "qx", "qcode", "qpart", "qvalue", "qsalt")
        met = rows.groupBy("part", "value", "salt").cogroup(probes.groupBy("qpart", "qvalue", "qsalt")).applyInArrow(_search(k, within), "query_id long, vec_id long, score double")
        best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    asking = coded.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx"), F.col("code").alias("qcode"))
    wanted = min(k, coded.select("vec_id").distinct().limit(k + 1).count() - 1)
    out = None
    for within in [*range(radius, SCAN_FROM), bits]:
        found = stored(nearest(asking, within), "ann-found")
        full = stored(found.groupBy(F.col("query_id").alias("full_id")).agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select("full_id"), "ann-full")
        done = found.join(full, F.col("query_id") == F.col("full_id"), "left_semi") if within < bits else found
        out = done if out is None else out.union(done)
        if within < bits:
            asking = stored(asking.join(full, F.col("query_id") == F.col("full_id"), "left_anti"), "ann-asking")
            if asking.isEmpty():
                break
    return out
