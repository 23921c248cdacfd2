"""Near-duplicate vectors by search in robust-pruned flat graphs.

Equal vectors of one label are one class. The classes of a label are dealt to shards around sampled centres, each class
to its `overlap` nearest, so shards overlap. In a shard every vector gets the list of its nearest ones, pruned of those
that a nearer one stands for, and reversed edges; a vector's adjacency is the union over its shards. Every vector is then
searched for: a greedy beam search from the shard's medoid leads to its surroundings, and the range expands from there
through neighbours as long as they lie within the range (with some slack), so all that are near are met. Pairs are
verified in double precision. A pair that two shards share is counted in the first.

Recall is audited on a bounded sample of vectors against all, as the mean share of its links over the sampled vectors that
have any (null: none has); if it falls short, the overlap doubles and the work is done again, in the end with every class in
every shard.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link
with nothing (component: their own id; kept); vectors of different lengths never link; equal rows of one id are one vector
and not each other's links, and different vectors of one id are linked as any others are, each with its own n_links, and in
one component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, stored
from .vectors import matrix, units, vectors

THRESHOLD = 0.98
#: Vectors to a centre, and the most centres that a label's vectors are compared with.
SHARD_ROWS = 1000
MAX_CENTRES = 512
#: Members at which a shard is cut into blocks, whose pairs are then shards.
MAX_SHARD = 6000
DEGREE = 16
POOL = 48
BEAM = 16
ALPHA = 1.2
#: How far under the threshold a vector may lie for its neighbours to be looked at.
SLACK = 0.06
AUDIT_VECTORS = 200
#: Vectors of a shard that are searched for at a time (a multiple of 8), and nodes that are expanded at a time.
QUERY_BLOCK = 512
EXPAND_NODES = 50_000
AUDIT_RECALL = 0.99
#: Members of a label that one task compares with the centres.
DEAL_ROWS = 20_000


def _nearest_centres(overlap: int):
    def run(key: tuple, members: pa.Table, centres: pa.Table) -> pa.Table:
        if not members.num_rows or not centres.num_rows:
            return pa.table({"class_id": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "shards": pa.array([], pa.list_(pa.int32()))})
        x, c = units(matrix(members.column("x"))), units(matrix(centres.column("cx")))
        number = centres.column("centre").to_numpy()
        take = min(overlap, len(c))
        near = np.sort(number[np.argpartition(-(x @ c.T), take - 1, axis=1)[:, :take]], axis=1).astype(np.int32)
        shards = pa.ListArray.from_arrays(pa.array(np.arange(len(x) * take + 1, step=take), pa.int32()), pa.array(near.ravel()))
        ids = members.column("class_id").combine_chunks()
        return pa.table({"class_id": ids.take(pa.array(np.repeat(np.arange(len(x)), take))), "shard": pa.array(near.ravel()), "shards": shards.take(pa.array(np.repeat(np.arange(len(x)), take)))})

    return run


def robust_prune(x: np.ndarray, at: int, pool: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of a pool in falling order of nearness, those that no chosen nearer one stands for."""
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    between = np.sqrt(np.maximum(0, 2 - 2 * (x[pool] @ x[pool].T)))
    chosen, open_ = [], np.ones(len(pool), bool)
    for i in range(len(pool)):
        if open_[i]:
            chosen.append(i)
            if len(chosen) == degree:
                break
            open_ &= alpha * between[i] > far
    return pool[chosen]


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of a shard: pruned nearest lists with reversed edges."""
    n = len(x)
    lists: list[np.ndarray] = [np.empty(0, np.int64)] * n
    take = min(POOL, n - 1)
    if take < 1:
        return lists
    for a in range(0, n, 1024):
        sims = x[a : a + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        pool = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        for i in range(len(sims)):
            p = pool[i][np.argsort(-sims[i, pool[i]], kind="stable")]
            lists[a + i] = robust_prune(x, a + i, p, sims[i, p])
    src = np.repeat(np.arange(n), [len(p) for p in lists])
    dst = np.concatenate(lists)
    code = np.unique(np.concatenate((src * n + dst, dst * n + src)))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


def _rows(graph: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency as one flat array and where each node's part starts."""
    start = np.concatenate(([0], np.cumsum([len(g) for g in graph]))).astype(np.int64)
    return start, (np.concatenate(graph) if graph else np.empty(0)).astype(np.int64)


def greedy_search(x: np.ndarray, start: np.ndarray, flat: np.ndarray, medoid: int, queries: np.ndarray, beam: int = BEAM, steps: int = 64, width: int = 4 * DEGREE) -> np.ndarray:
    """For every query the nodes that a beam search for it from the medoid ends with; a hub shows `width` neighbours."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    ids[:, 0] = medoid
    sims = np.full((n, beam), -3.0)
    sims[:, 0] = x[queries] @ x[medoid]
    done = np.zeros((n, beam), bool)
    size = np.minimum(np.diff(start), width)
    for _ in range(steps):
        best = np.where(done | (ids < 0), -3.0, sims)
        at = best.argmax(1)
        go = np.flatnonzero(best[np.arange(n), at] > -3)
        if not len(go):
            break
        done[go, at[go]] = True
        node = ids[go, at[go]]
        step = np.arange(max(1, int(size[node].max())))
        near = np.where(step < size[node][:, None], flat[np.minimum(start[node][:, None] + step, max(0, len(flat) - 1))] if len(flat) else -1, -1)
        s = np.einsum("qrd,qd->qr", x[near], x[queries[go]])
        s[near < 0] = -3
        s[(near[:, :, None] == ids[go][:, None, :]).any(2)] = -3
        all_ids, all_sims = np.concatenate((ids[go], near), 1), np.concatenate((sims[go], s), 1)
        all_done = np.concatenate((done[go], np.zeros_like(near, bool)), 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        rows = np.arange(len(go))[:, None]
        ids[go], sims[go], done[go] = np.where(all_sims[rows, top] > -3, all_ids[rows, top], -1), all_sims[rows, top], all_done[rows, top]
    return ids


def expand_range(x: np.ndarray, start: np.ndarray, flat: np.ndarray, queries: np.ndarray, seeds: np.ndarray, threshold: float, slack: float = SLACK) -> np.ndarray:
    """A row of marks for each query: the nodes with cosine >= threshold met from its seeds through nodes within the range."""
    n, b = len(x), len(queries)
    seen, hits, ahead = (np.zeros((b, n), bool) for _ in range(3))
    q, v = np.nonzero(seeds >= 0)
    ahead[q, seeds[q, v]] = True
    ahead[np.arange(b), queries] = True  # a vector is near itself
    while True:
        q, v = np.nonzero(ahead & ~seen)
        if not len(q):
            break
        seen[q, v] = True
        ahead[:] = False
        for at in range(0, len(q), EXPAND_NODES):
            qi, vi = q[at : at + EXPAND_NODES], v[at : at + EXPAND_NODES]
            sims = np.einsum("ij,ij->i", x[queries[qi]], x[vi])
            hits[qi[sims >= threshold], vi[sims >= threshold]] = True
            go = sims >= threshold - slack
            qi, vi = qi[go], vi[go]
            size = start[vi + 1] - start[vi]
            lead = np.concatenate(([0], np.cumsum(size)))
            for first in np.searchsorted(lead, np.arange(0, lead[-1], 16 * EXPAND_NODES), side="right") - 1 if len(vi) else []:
                last = max(first + 1, int(np.searchsorted(lead, lead[first] + 16 * EXPAND_NODES, side="right")))
                w = size[first:last]
                place = np.repeat(start[vi[first:last]] - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(w.sum())
                ahead[np.repeat(qi[first:last], w), flat[place]] = True
    hits[np.arange(b), queries] = False
    return hits


def met_pairs(x: np.ndarray, graph: list[np.ndarray], threshold: float) -> np.ndarray:
    """The pairs within the range that either side met, as packed rows of marks: n * n / 8 bytes, whatever they number."""
    n = len(x)
    start, flat = _rows(graph)
    medoid = int((x @ x.mean(0)).argmax())
    marks = np.zeros((n, -(-n // 8)), np.uint8)
    for a in range(0, n, QUERY_BLOCK):
        queries = np.arange(a, min(n, a + QUERY_BLOCK))
        marks[queries] = np.packbits(expand_range(x, start, flat, queries, greedy_search(x, start, flat, medoid, queries), threshold), axis=1)
    for a in range(0, n, QUERY_BLOCK):  # QUERY_BLOCK is a multiple of 8
        for b in range(0, a + 1, QUERY_BLOCK):
            upper = np.unpackbits(marks[b : b + QUERY_BLOCK, a // 8 : (a + QUERY_BLOCK) // 8], axis=1)
            lower = np.unpackbits(marks[a : a + QUERY_BLOCK, b // 8 : (b + QUERY_BLOCK) // 8], axis=1)
            rows, cols = min(QUERY_BLOCK, n - a), min(QUERY_BLOCK, n - b)
            both = lower[:rows, :cols] | upper[:cols, :rows].T
            lower[:rows, :cols], upper[:cols, :rows] = both, both.T
            marks[a : a + QUERY_BLOCK, b // 8 : (b + QUERY_BLOCK) // 8] = np.packbits(lower, axis=1)
            marks[b : b + QUERY_BLOCK, a // 8 : (a + QUERY_BLOCK) // 8] = np.packbits(upper, axis=1)
    return marks


def _shard_graph(key: tuple, group: pa.Table) -> pa.Table:
    ids = group.column("class_id").to_numpy()
    graph = build_graph(units(matrix(group.column("x"))))
    ends = np.concatenate(([0], np.cumsum([len(g) for g in graph])))
    return pa.table({"class_id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[np.concatenate(graph).astype(np.int64)] if len(ids) else ids))})


def _search_shard(threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, left, right = key[1].as_py(), key[2].as_py(), key[3].as_py()
        ids, copies, block = (group.column(c).to_numpy() for c in ("class_id", "copies", "block"))
        x = units(matrix(group.column("x")))
        n = len(ids)
        place = {int(c): i for i, c in enumerate(ids)}
        graph = [np.array(sorted({place[c] for c in near if c in place and place[c] != i}), np.int64) for i, near in enumerate(group.column("near").to_pylist())]
        marks = met_pairs(x, graph, threshold)
        # a pair is counted in the first shard that holds both: where they share an earlier one it is left out here
        earlier = [[s for s in own if s < shard] for own in group.column("shards").to_pylist()]
        number = {s: i for i, s in enumerate(sorted({s for e in earlier for s in e}))}
        also = np.zeros((n, len(number)), np.float32)
        for i, e in enumerate(earlier):
            also[i, [number[s] for s in e]] = 1
        links = np.zeros(n, np.int64)
        for a in range(0, n, QUERY_BLOCK):
            row = np.unpackbits(marks[a : a + QUERY_BLOCK], axis=1, count=n).astype(bool)
            if left != right:
                row &= block[a : a + QUERY_BLOCK, None] != block[None]
            if number:
                row &= also[a : a + QUERY_BLOCK] @ also.T == 0
            links[a : a + QUERY_BLOCK] = row @ copies
            marks[a : a + QUERY_BLOCK] = np.packbits(row, axis=1)
        root = np.arange(n)
        while True:  # smallest place reachable
            new = root.copy()
            for a in range(0, n, QUERY_BLOCK):
                row = np.unpackbits(marks[a : a + QUERY_BLOCK], axis=1, count=n).astype(bool)
                new[a : a + QUERY_BLOCK] = np.minimum(new[a : a + QUERY_BLOCK], np.where(row, root[None], n).min(1, initial=n))
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(links)
        return pa.table({"class_id": pa.array(ids[some]), "root": pa.array(ids[root[some]]), "links": pa.array(links[some])})

    return run


def _audit(sample: list[tuple[int, int, int, list[float]]], threshold: float):
    """Links of the sampled classes, counted by comparing them with every class."""
    ids = np.array([s[0] for s in sample], np.int64)
    labels = np.array([s[1] for s in sample])
    lengths = np.array([len(s[3]) for s in sample])

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            other, label, copies = (np.asarray(batch.column(c)) for c in ("class_id", "label", "copies"))
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                mine, theirs = np.flatnonzero(lengths == d), np.flatnonzero(dims == d)
                if len(mine):
                    a, b = units(np.array([sample[i][3] for i in mine])), units(matrix(batch.column("x").take(pa.array(theirs))))
                    near = (a @ b.T >= threshold) & (labels[mine][:, None] == label[theirs][None]) & (ids[mine][:, None] != other[theirs][None])
                    total[mine] += (near * copies[theirs][None]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["class_id", "true_links"])

    return run


def audit_recall(classes: DataFrame, links: DataFrame, threshold: float, number: int = AUDIT_VECTORS) -> float | None:
    """Mean share of its true links that a vector of a bounded sample has; None where no sampled vector has a link.

    Half of the sample is any classes, half are classes that links were found for, as links may be rare.
    """
    by_hash = F.xxhash64("class_id", F.lit(3))
    linked = links.select(F.col("class_id").alias("lid")).orderBy(F.xxhash64("lid", F.lit(3)), "lid").limit(number)
    cols = ["class_id", "label", "copies", "x"]
    sample = {r[0]: tuple(r) for r in classes.orderBy(by_hash, "class_id").limit(number).select(*cols).collect()}
    sample |= {r[0]: tuple(r) for r in classes.join(F.broadcast(linked), F.col("class_id") == F.col("lid")).select(*cols).collect()}  # number rows at most
    if not sample:
        return None
    true = classes.mapInArrow(_audit(list(sample.values()), threshold), "class_id long, true_links long").groupBy("class_id").agg(F.sum("true_links").alias("true_links"))
    # a row for each sampled class
    seen = links.join(F.broadcast(true), "class_id", "right").where("true_links > 0")
    return seen.agg(F.avg(F.least(F.coalesce("links", F.lit(0)), "true_links") / F.col("true_links"))).first()[0]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD, overlap: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for each row: links are pairs of one label with cosine >= threshold."""
    valid = vectors(df, id_col, vector_col, F.col(label_col).cast("long").alias("label")).where("label is not null")
    named = stored(valid.withColumn("class_key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("x").cast("array<string>"), ",")), 256)), "dedup-vectors")
    # an id counts once in a class; classes have numbers of their own, as an id may be in several
    ids = stored(named.select("class_key", "vec_id").distinct(), "dedup-ids")
    held = ids.groupBy(F.col("class_key").alias("hk")).agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    first = named.groupBy("class_key").agg(F.first("label").alias("label"), F.first("x").alias("x"))
    classes = stored(first.join(held, F.col("class_key") == F.col("hk")).select(F.monotonically_increasing_id().alias("class_id"), "class_key", "rep", "copies", "label", "x", F.size("x").alias("dim")), "dedup-classes")

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    by_hash = Window.partitionBy("label", "dim", "salt").orderBy(F.xxhash64("class_id", F.lit(9)), "class_id")
    spread = classes.withColumn("salt", F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(64)).cast("int"))
    first = spread.withColumn("nth", F.row_number().over(by_hash)).where(f"nth <= {MAX_CENTRES // 64 + 1}")
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("label", "dim").orderBy("nth", "salt")))
    wanted = F.least(F.lit(MAX_CENTRES), F.ceil(F.col("rows") / SHARD_ROWS))
    renamed = sizes.withColumnsRenamed({"label": "sl", "dim": "sd"})
    centres = ranked.join(renamed, (ranked.label == renamed.sl) & (ranked.dim == renamed.sd)).where(F.col("nth") <= wanted).select("label", "dim", "rows", F.col("nth").cast("int").alias("centre"), F.col("x").alias("cx"))
    turns = F.ceil(F.col("rows") / DEAL_ROWS).cast("int")
    dealt_centres = centres.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1))).select(F.col("label").alias("cl"), F.col("dim").alias("cd"), F.col("turn").alias("ct"), "centre", "cx")
    members = classes.join(renamed, (classes.label == renamed.sl) & (classes.dim == renamed.sd)).withColumn("turn", F.pmod(F.xxhash64("class_id", F.lit(2)), turns).cast("int")).select("label", "dim", "turn", "class_id", "x")

    while True:
        assigned = stored(
            members.groupBy("label", "dim", "turn").cogroup(dealt_centres.groupBy("cl", "cd", "ct")).applyInArrow(_nearest_centres(overlap), "class_id long, shard int, shards array<int>"), "dedup-shards"
        )
        placed = assigned.join(classes.withColumnRenamed("class_id", "cid"), F.col("class_id") == F.col("cid")).drop("cid")
        counts = placed.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / MAX_SHARD).cast("int").alias("blocks")).withColumnsRenamed({"label": "kl", "dim": "kd", "shard": "ks"})
        cut = placed.join(counts, (F.col("label") == F.col("kl")) & (F.col("dim") == F.col("kd")) & (F.col("shard") == F.col("ks")))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(4)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cut = cut.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).withColumn("place", F.xxhash64("label", "dim"))
        graph = cut.groupBy("place", "shard", "left", "right").applyInArrow(_shard_graph, "class_id long, near array<long>")
        union = graph.groupBy("class_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).withColumnRenamed("class_id", "gid")
        found = cut.join(union, cut.class_id == union.gid).select("place", "shard", "left", "right", "class_id", "copies", "block", "shards", "x", "near").groupBy("place", "shard", "left", "right").applyInArrow(_search_shard(threshold), "class_id long, root long, links long")
        found = stored(found, "dedup-links")
        links = stored(found.groupBy("class_id").agg(F.sum("links").alias("links")), "dedup-counts")
        recall = audit_recall(classes, links, threshold)
        if recall is None or recall >= AUDIT_RECALL or overlap >= MAX_CENTRES:  # then every class is in every shard
            break
        overlap *= 2

    # classes that one id is in belong together, and a component is named by its least id
    numbered = classes.select(F.col("class_key").alias("nk"), "class_id")
    twice = ids.groupBy(F.col("vec_id").alias("tid")).agg(F.count("*").alias("n"), F.min("class_key").alias("first_key")).where("n > 1")
    bridges = ids.join(twice, ids.vec_id == twice.tid).join(numbered, F.col("class_key") == F.col("nk")).select(F.col("class_id").alias("a"), "first_key")
    bridges = bridges.join(numbered, F.col("first_key") == F.col("nk")).select("a", F.col("class_id").alias("b"))
    reached = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")).union(bridges), "dedup-components").withColumnRenamed("component", "in_component")
    least = reached.join(classes.select("class_id", "rep"), F.col("node") == F.col("class_id")).groupBy(F.col("in_component").alias("whole")).agg(F.min("rep").alias("component"))
    components = reached.join(least, F.col("in_component") == F.col("whole")).select("node", "component")
    linked = classes.select("class_key", "class_id", "copies", "rep").join(links.withColumnRenamed("class_id", "lid"), F.col("class_id") == F.col("lid"), "left").join(components, F.col("class_id") == F.col("node"), "left")
    linked = linked.select(F.col("class_key").alias("ck"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    answers = named.select("vec_id", "class_key").join(linked, F.col("class_key") == F.col("ck")).select("vec_id", "n_links", "component")
    id_ = F.col(id_col).cast("long")
    rest = df.where(~F.coalesce(usable_row(vector_col, label_col, id_col), F.lit(False))).select(id_.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), id_.alias("component"))
    return answers.union(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))


def usable_row(vector_col: str, label_col: str, id_col: str):
    from .vectors import usable

    return usable(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
