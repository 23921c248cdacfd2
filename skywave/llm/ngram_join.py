"""N-gram Jaccard self-join by universe partition and pigeonhole.

Every document is the set of its distinct k-word shingles, as 64-bit hashes. Sizes fall into bands. For the pairs whose
larger set is in a band, the symmetric difference is at most H, a number of that band. The hash universe is cut into
segments that carry units: one for a segment indexed whole (its signature), two for one indexed with its one-deletion
neighbourhood (the signatures of the segment, and of the segment less any one element). With H + 1 + q units, segments
worth q + 1 units agree in any two linked sets. A set whose segments of very few elements are worth at most q leaves
those out, as they would agree by chance; so some segment that both index agrees. How many segments take a deletion
follows from the cost of the signatures and of chance agreements.

Documents with equal sets form a class; only classes are compared. Classes that share a signature, and whose 512-bit
parity sketches differ by no more bits than linked sets can, are candidates; connected candidates form a cluster. A
cluster is cut into blocks of bounded weight, and each pair of blocks is one task, which verifies all its pairs exactly by
intersection sizes and returns a spanning forest and link counts, never the pairs.

Defined cases: null or empty text and text without words have no shingles and no links; a null id takes no part and has
a null component; rows that share an id are one node; extra columns are ignored; an empty table gives an empty result.
Hashes have 64 bits for shingles (a false agreement inside one pair has odds of about n^2 / 2^64) and 128 for classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, WordHashes, connected_components, mix64, shingle_set, stored

#: Sizes of a band grow by this factor: wider bands need fewer indexes for each set, but more segments in each.
BAND_GROWTH = 1.25
#: Classes that a task remembers, so as not to sign their copies again.
SEEN_CLASSES = 1 << 20
#: Signatures that a task packs together.
PACK_SIGNATURES = 1 << 20
#: Bytes of text for one range of signatures: ranges grow in number with the corpus.
SLOT_BYTES = 1 << 20
#: What a segment of at most two elements costs later by chance agreements, in units of one signature written.
CHANCE_COST = 1.0
#: Classes of one signature that are compared at a time.
BUCKET_BLOCK = 4096
SKETCH_BITS = 512
#: Bytes of wide sketches in a block of a cluster.
BLOCK_SKETCHES = 4 << 20
#: Parts over which the copies of one text are spread where they are joined to their class.
COPY_PARTS = 32
#: Shingles in a block of a cluster.
BLOCK_SHINGLES = 400_000


def band_starts(growth: float = BAND_GROWTH) -> np.ndarray:
    """First sizes of the bands, up to sizes that no document in memory can reach."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, int(at[-1] * growth)))
    return np.array(at, np.int64)


_STARTS = band_starts()


def band_difference(band: int, percent: int) -> int:
    """Most elements by which two linked sets differ when the larger one is in this band."""
    return int((100 - percent) * 2 * (int(_STARTS[band + 1]) - 1) // (100 + percent))


def bands_of(n: int, percent: int) -> range:
    """Bands under which a set of n elements is indexed: its own, up to that of its largest partner."""
    lo, hi = np.searchsorted(_STARTS, [n, n * 100 // percent], side="right") - 1
    return range(int(lo), int(hi) + 1)


def _at_most(few: int, mean: float) -> float:
    """Chance that a segment has at most `few` elements, when it has `mean` of them on average (Poisson)."""
    return math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(few + 1))


@dataclass(frozen=True)
class Allocation:
    """How a band is indexed: segments in all, how many (the first ones) take one deletion, spare units, light sizes."""

    segments: int
    deletions: int
    spare: int
    light: int


def allocate(band: int, percent: int, deletions: int | None = None) -> Allocation | None:
    """The cheapest allocation of the units of a band; None where linked sets are equal. deletions fixes their number."""
    difference = band_difference(band, percent)
    if not difference:
        return None
    size, best = float(_STARTS[band]), None
    limit = (difference + 1) // 2
    for d in range(min(limit, 24) + 1) if deletions is None else [min(deletions, limit)]:
        light = 1 if size / (difference + 1 - d) >= 7 else 0
        spare = 0
        for _ in range(4 if difference >= 8 else 0):  # spare units make segments smaller, and so need a few more
            segments = difference + 1 + spare - d
            expected = (segments + d) * _at_most(light, size / segments)
            spare = math.ceil(expected + 2 * math.sqrt(expected))
        segments = difference + 1 + spare - d
        mean = size / segments
        chance = (segments - d) * _at_most(2, mean) + d * _at_most(3, mean)
        cost = segments + d * mean + CHANCE_COST * chance
        if best is None or cost < best[0]:
            best = (cost, Allocation(segments, d, spare, light))
    return best[1]


class Bands(dict):
    """band -> its allocation, worked out once."""

    def __init__(self, percent: int, deletions: int | None = None):
        super().__init__()
        self.percent, self.deletions = percent, deletions

    def __missing__(self, band: int) -> Allocation | None:
        self[band] = allocate(band, self.percent, self.deletions)
        return self[band]


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a sorted set under all bands in which it may have partners."""
    out = []
    with np.errstate(over="ignore"):
        g = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g, dtype=np.uint64)))
        for band in bands_of(len(h), bands.percent):
            a = bands[band]
            if a is None:
                continue  # linked sets are equal here, and equal sets are one class
            m = a.segments
            seg = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(seg, np.arange(m + 1))
            size = cut[1:] - cut[:-1]
            units = np.where(np.arange(m) < a.deletions, 2, 1)
            # a partner's segment can have one element less where a deletion is allowed
            light_units = int(units[size <= a.light + (units == 2)].sum())
            took = size > a.light if light_units <= a.spare else np.ones(m, bool)
            tag = mix64(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 40))
            whole = sums[cut[1:]] - sums[cut[:-1]]
            out.append(mix64(whole[took] ^ tag[took]))
            if a.deletions:
                one = np.flatnonzero((seg < a.deletions) & took[seg])
                out.append(mix64((whole[seg[one]] - g[one]) ^ tag[seg[one]]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the elements by `bits` hash values: two sketches differ in at most as many bits as the sets in elements."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def sketch_bits(n: int) -> int:
    """Bits of a wide sketch: the power of two from n on, so that unrelated sets of any size stay far apart in it."""
    return max(SKETCH_BITS, 1 << (n - 1).bit_length())


#: Rows of documents (slot null) and packed signatures (slot not null: its range; ids holds the classes met in it).
INDEX_SCHEMA = "doc_id long, n long, fp1 long, fp2 long, narrow binary, wide binary, slot long, count int, packed binary, ids binary"


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
    return int(a), int(b)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x, those of equal place together, so that places that hardly change take no room."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def pack(sigs: np.ndarray, owner: np.ndarray, fps: np.ndarray, slots: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Signatures by range of their upper half: the sorted lower halves as gaps, and which class each is of.

    A signature takes about six bytes so, where a row for each takes sixteen and more. Equal lower halves in one range
    are taken for one signature; ranges grow in number with the corpus, so that such accidents stay rare.
    """
    slot = ((sigs >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    low = sigs.astype(np.uint32)
    order = np.lexsort((low, slot))
    slot, low, owner = slot[order], low[order], owner[order]
    cut = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]))
    codec = pa.Codec("zstd", compression_level=1)
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        own, at = np.unique(owner[i:j], return_inverse=True)
        gaps = np.diff(low[i:j], prepend=np.uint32(0))
        yield int(slot[i]), int(j - i), codec.compress(_planes(gaps) + _planes(at.astype(np.uint16)), asbytes=True), fps[own].tobytes()


def unpack(count: int, packed: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lower halves, classes) of a packed range."""
    raw = pa.Codec("zstd").decompress(packed, decompressed_size=count * 6, asbytes=True)
    return np.cumsum(_unplanes(raw[: count * 4], np.uint32), dtype=np.uint32), np.frombuffer(ids, np.int64)[_unplanes(raw[count * 4 :], np.uint16)]


def _index(k: int, percent: int, deletions: int | None, slots: int):
    """A row for each document with its class, and packed signatures; copies that a task met before are not signed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bands, seen = WordHashes(), Bands(percent, deletions), set()
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("narrow", pa.binary()), ("wide", pa.binary()), ("slot", pa.int64()), ("count", pa.int32()), ("packed", pa.binary()), ("ids", pa.binary())])
        sigs, fps, held = [], [], 0

        def packs() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            rows = list(pack(np.concatenate(sigs), owner, np.array(fps, np.int64), slots))
            nulls = [pa.nulls(len(rows), schema.field(c).type) for c in range(6)]
            return pa.RecordBatch.from_arrays(nulls + [pa.array(c, schema.field(6 + i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=schema)

        for batch in batches:
            rows = batch.num_rows
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            n, fp1, fp2 = (np.zeros(rows, np.int64) for _ in range(3))
            narrow, wide = [None] * rows, [None] * rows
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                h = shingle_set(text.as_py(), k, cache)
                n[i] = len(h)
                if not len(h):
                    continue
                fp = fp1[i], fp2[i] = _fingerprint(h)
                if fp in seen:
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(fp)
                own = signatures(h, bands)
                if not len(own):
                    continue
                full = sketch(h, sketch_bits(len(h)))
                narrow[i] = np.bitwise_xor.reduce(full.reshape(-1, SKETCH_BITS // 8), axis=0).tobytes()
                wide[i] = full.tobytes()
                sigs.append(own)
                fps.append(fp[0])
                held += len(own)
                if held >= PACK_SIGNATURES or len(sigs) == 1 << 16:
                    yield packs()
                    sigs, fps, held = [], [], 0
            rest = [pa.nulls(rows, schema.field(c).type) for c in range(6, 10)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(fp1), pa.array(fp2), pa.array(narrow, pa.binary()), pa.array(wide, pa.binary()), *rest], schema=schema)
        if sigs:
            yield packs()

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, each whole; a run may go over any number of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cut = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if held and last != tuple(k[:, i]):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[:, i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed ranges sorted by slot -> (bucket, members, fp1) of the signatures that more than one class has."""
    for t in _groups(batches, ["slot"]):
        parts = [unpack(*row) for row in zip(*(t.column(c).to_pylist() for c in ("count", "packed", "ids")), strict=True)]
        low, fp = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        # only lower halves that come up again are looked at closely
        order = np.argsort(low, kind="stable")
        low, fp = low[order], fp[order]
        same = low[1:] == low[:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        low, fp = low[again], fp[again]
        order = np.lexsort((fp, low))
        low, fp = low[order], fp[order]
        fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (fp[1:] != fp[:-1])))[: len(low)]
        low, fp = low[fresh], fp[fresh]
        if not len(low):
            continue
        start = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        members = np.diff(start, append=len(low))
        with np.errstate(over="ignore"):
            code = mix64(fp.view(np.uint64))
            bucket = mix64(np.add.reduceat(code, start) ^ mix64(np.bitwise_xor.reduceat(code, start) + members.astype(np.uint64)))
        of = np.repeat(np.arange(len(start)), members)
        took = members[of] > 1
        out = pa.table({"bucket": bucket[of][took].view(np.int64), "members": members[of][took].astype(np.int64), "fp1": fp[took]})
        yield from out.to_batches(max_chunksize=1 << 16)


def near_forest(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """For each member the first of those it is connected to by pairs that sizes and sketches leave possible.

    Sketches of unlike width are compared in the narrower one's bits: folding a sketch by half keeps its bound.
    """
    c = len(n)
    order = np.argsort(n, kind="stable")
    size = n[order]
    words = np.array([len(sketches[i]) // 8 for i in order])
    by_width = {}  # the widths grow with the sizes, so each has one run of members
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        m = np.frombuffer(b"".join(sketches[order[i]] for i in at), np.uint64).reshape(len(at), w)
        by_width[int(w)] = (at, {int(w): m})

    def folded(w: int, to: int) -> np.ndarray:
        forms = by_width[w][1]
        if to not in forms:
            forms[to] = np.bitwise_xor.reduce(forms[w].reshape(len(forms[w]), w // to, to), axis=1)
        return forms[to]

    lead, left = np.arange(c), np.ones(c, bool)
    place = np.zeros(c, np.int64)
    for at, _ in by_width.values():
        place[at] = np.arange(len(at))
    for x in range(c):
        if not left[x]:
            continue
        left[x] = False
        todo = [x]
        while todo:
            y = todo.pop()
            wy = int(words[y])
            lo = np.searchsorted(size, -(-percent * size[y] // 100), side="left")
            hi = np.searchsorted(size, 100 * size[y] // percent, side="right")
            for w, (at, _) in by_width.items():
                i, j = np.searchsorted(at, [lo, hi])
                rest = np.flatnonzero(left[at[i:j]]) + i
                if not len(rest):
                    continue
                to = min(w, wy)
                d = np.bitwise_count(folded(w, to)[rest] ^ folded(wy, to)[place[y]]).sum(1, dtype=np.int64)
                found = at[rest[d <= (100 - percent) * (size[at[rest]] + size[y]) // (100 + percent)]]
                lead[found], left[found] = x, False
                todo += found.tolist()
    out = np.empty(c, np.int64)
    out[order] = order[lead]
    return out


def _candidates(keys: list[str], percent: int):
    """Rows sorted by keys -> a spanning forest of the possible pairs of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for t in _groups(batches, keys):
            if t.num_rows < 2:
                continue
            fp = t.column("fp1").to_numpy()
            lead = near_forest(t.column("n").to_numpy(), t.column("sketch").to_pylist(), percent)
            own = np.flatnonzero(lead != np.arange(len(fp)))
            a.append(fp[own])
            b.append(fp[lead[own]])
            held += len(own)
            if held >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _block_pairs(df: DataFrame, key: str, blocks: str, *cols: str) -> DataFrame:
    """Each row of a group once for each pair of blocks that its block is in: (key, left, right, cols)."""
    return (
        df.withColumn("block", F.pmod(F.xxhash64("fp1"), F.col(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .select(key, F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", *cols)
    )


def _forest(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Possible pairs (a, b) in df(key, left, right, fp1, n, sketch), a pair of blocks at a time."""
    return df.repartition(key, "left", "right").sortWithinPartitions(key, "left", "right").mapInArrow(_candidates([key, "left", "right"], percent), "a long, b long")


def _verify(k: int, percent: int):
    """Exact links among the classes of one pair of blocks: (doc_id, root, links) for each class that has any."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        cache, ids, sets, copies, block, seen = WordHashes(), [], [], [], [], set()
        cols = [group.column(c).to_pylist() for c in ("doc_id", "fp1", "fp2", "copies", "block")]
        for i, text in enumerate(group.column("text").cast(pa.binary()).to_pylist()):
            h = shingle_set(text, k, cache)
            fp = (cols[1][i], cols[2][i])
            if len(h) and fp not in seen and _fingerprint(h) == fp:
                seen.add(fp)
                ids.append(cols[0][i])
                sets.append(h)
                copies.append(cols[3][i])
                block.append(cols[4][i])
        d = len(ids)
        size = np.fromiter(map(len, sets), np.int64, d)
        links, root = np.zeros(d, np.int64), list(range(d))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if d > 1:
            copies, block = np.array(copies, np.int64), np.array(block)
            tokens = np.concatenate(sets)
            _, token, count = np.unique(tokens, return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(d), size)
            shared = count[token] > 1
            token, owner = token[shared], owner[shared]
            by_token = np.argsort(token, kind="stable")
            posting = owner[by_token]
            start = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(count)))))
            of = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=d))))
            for x in np.flatnonzero(block == left):
                mine = token[of[x] : of[x + 1]]
                if not len(mine):
                    continue
                width = start[mine + 1] - start[mine]
                where = np.repeat(start[mine] - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
                common = np.bincount(posting[where], minlength=d)
                hit = 100 * common >= percent * (size[x] + size - common)
                hit &= (np.arange(d) > x) if left == right else (block == right)
                for y in np.flatnonzero(hit):
                    links[x] += copies[y]
                    links[y] += copies[x]
                    a, b = find(int(x)), find(int(y))
                    root[max(a, b)] = min(a, b)
        out = [(ids[x], ids[find(x)], int(links[x])) for x in range(d) if links[x]]
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()), "root": pa.array([o[1] for o in out], pa.int64()), "links": pa.array([o[2] for o in out], pa.int64())})

    return run


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 3, percent: int = 90, deletions: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row: links are pairs with Jaccard similarity >= percent / 100.

    component_id is the smallest id reachable by links, the row's own included; n_links counts the other rows linked
    directly. deletions fixes the number of segments with a deletion in each band (tests); by default costs decide.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    index = stored(docs.mapInArrow(_index(k, percent, deletions, 1 + size // SLOT_BYTES), INDEX_SCHEMA), "ngram-index")
    rows = index.where("slot is null").select("doc_id", "n", "fp1", "fp2", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_PARTS)).cast("int").alias("part"))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts"))

    # signatures that classes share; buckets with the same members count once
    packed = index.where("slot is not null").select("slot", "count", "packed", "ids")
    buckets = packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(_shared, "bucket long, members long, fp1 long").distinct()
    sketches = stored(index.where("wide is not null").select(F.col("fp1").alias("sf"), "n", "narrow", "wide").dropDuplicates(["sf"]), "ngram-sketches")
    met = buckets.join(sketches.select("sf", "n", F.col("narrow").alias("sketch")), buckets.fp1 == sketches.sf).withColumn("blocks", F.ceil(F.col("members") / BUCKET_BLOCK))
    near = connected_components(_forest(_block_pairs(met, "bucket", "blocks", "fp1", "n", "sketch"), "bucket", percent), "ngram-candidates").withColumnsRenamed({"node": "cfp", "component": "near"})
    # the same again inside what is connected so far, by sketches as wide as the sets are large
    wide = near.join(sketches.select("sf", "n", F.col("wide").alias("sketch")), near.cfp == sketches.sf).select("near", F.col("cfp").alias("fp1"), "n", "sketch")
    parts = wide.groupBy(F.col("near").alias("wn")).agg(F.ceil(F.sum(F.octet_length("sketch")) / BLOCK_SKETCHES).alias("blocks"))
    clusters = connected_components(_forest(_block_pairs(wide.join(parts, wide.near == parts.wn), "near", "blocks", "fp1", "n", "sketch"), "near", percent), "ngram-near").withColumnsRenamed({"node": "cfp", "component": "cluster"})

    members = stored(classes.join(clusters, classes.fp1 == clusters.cfp).select("cluster", "rep", "fp1", "fp2", "n", "copies"), "ngram-members")
    weights = members.groupBy(F.col("cluster").alias("wc")).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = _block_pairs(members.join(weights, members.cluster == weights.wc), "cluster", "blocks", "rep", "fp1", "fp2", "copies")
    # a merge at every size: the list of candidates grows with the corpus
    found = (
        docs.join(dealt.hint("merge"), docs.doc_id == dealt.rep)
        .select("cluster", "left", "right", "block", "doc_id", "fp1", "fp2", "copies", "text")
        .groupBy("cluster", "left", "right")
        .applyInArrow(_verify(k, percent), "doc_id long, root long, links long")
    )
    found = stored(found, "ngram-links")
    components = connected_components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), "ngram-components")
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("links")).join(components, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("lrep"), "links", "component")
    named = classes.join(linked, classes.rep == linked.lrep, "left").select(
        F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "parts"
    )
    # copies of one text are spread over parts; a class has a row for each part that any of its copies is in
    named = named.withColumn("cp", F.explode(F.expr(f"filter(sequence(0, {COPY_PARTS - 1}), i -> getbit(parts, i) = 1)")))
    same = (rows.fp1 == named.c1) & (rows.fp2 == named.c2) & (rows.n == named.cn) & (rows.part == named.cp) & rows.doc_id.isNotNull()
    return rows.join(named, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
