import hashlib

import numpy as np
import pytest

from skywave.llm.ann import nearest_neighbours
from skywave.llm.near_dedup import near_duplicates
from skywave.llm.warc import read_archive, write_archive


def clustered(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):  # near copies
        x[i] = x[(i * 7 + 1) % n] + rng.normal(size=dim) * 0.02
    x[5] = x[6] = x[7]
    return x.astype(np.float32), rng.integers(0, 3, n)


ODD = [(5001, None, 1), (5002, [0.0] * 16, 1), (5003, [float("nan")] + [1.0] * 15, 1), (5004, [None] + [1.0] * 15, 2), (5005, [1.0] * 16, None), (5006, [1.0, 2.0], 1), (5007, [float("inf")] + [0.0] * 15, 0), (None, [1.0] * 16, 1)]


def table(spark, x, lab):
    rows = [(i, [float(v) for v in x[i]], int(lab[i])) for i in range(len(x))] + ODD
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'z' as kept")


def test_near_duplicates_match_brute_force(spark):
    x, lab = clustered()
    got = {r.vec_id: r for r in near_duplicates(table(spark, x, lab)).collect()}
    assert len(got) == len(x) + len(ODD)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].kept == (root[i] == i) for i in range(len(x)))
    for i, _, _ in ODD[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert near_duplicates(table(spark, x, lab).where("1 = 0")).count() == 0


def test_nearest_neighbours_recall(spark):
    x, lab = clustered(1200)
    got = nearest_neighbours(table(spark, x, lab), every=20, k=5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, len(x), 20):
        s = u @ u[q]
        s[q] = -2
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & set(np.lexsort((np.arange(len(x)), -s))[:5].tolist()))
        total += 5
    assert hits >= 0.9 * total
    assert nearest_neighbours(table(spark, x, lab).where("1 = 0")).count() == 0


def test_outlier_and_ordered_clusters_have_all_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 64))
    x = np.concatenate([c + rng.normal(size=(40, 64)) * 0.01 for c in centres])  # ids follow clusters
    x = np.concatenate((x, -x.mean(0, keepdims=True) * 50 + rng.normal(size=(1, 64))))  # 1200, far from all
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, every=40, k=5).collect():
        got.setdefault(r.query_id, []).append(r)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(range(0, 1201, 40)) and {len(v) for v in got.values()} == {5}
    s = u @ u[1200]
    s[1200] = -2
    assert [r.vec_id for r in sorted(got[1200], key=lambda r: r["rank"])] == np.lexsort((np.arange(1201), -s))[:5].tolist()


def test_few_usable_vectors_among_many_null_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(50 * i, [float(v) for v in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").union(spark.range(100_000, 160_000).selectExpr("id", "CAST(NULL AS array<double>)"))
    got = nearest_neighbours(df).collect()
    assert len(got) == 300 and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def plain_nearest(rows, every, k):
    """Every query against every row, one dot product at a time; equal to 12 digits is a tie."""
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    out = []
    for q, a in {i: v for i, v in unit if i % every == 0}.items():
        best = {}
        for i, b in unit:
            if i != q:
                best[i] = max(best.get(i, -2.0), float(sum(a * b)))
        out += [(q, r + 1, i) for r, (i, _) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("wide_from", [1 << 18, 1])
def test_ties_go_to_the_smaller_id_whatever_the_parts(spark, wide_from):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 64))
    for i in rng.choice(700, 392, replace=False):
        x[i] = x[0] + 0.01 * x[3]  # copies of one vector near the first query
    x[::7] = 3.0 * x[5]  # and parallel ones
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(8, [float(v) for v in x[8]]), (9, [float(v) for v in x[500]])]  # repeated ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [sorted((r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df.repartition(n), k=5, radius=16, wide_from=wide_from).collect()) for n in (1, 5)]
    assert got[0] == got[1] == plain_nearest(rows, 50, 5)


def test_wide_substrings_reach_the_recall(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([c + rng.normal(size=(20, 64)) * 0.3 for c in rng.normal(size=(60, 64))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest_neighbours(df, wide_from=1).collect()}
    want = {(q, i) for q, _, i in plain_nearest(rows, 50, 5)}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = nearest_neighbours(df, radius=8).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]


def test_archive_round_trip(spark):
    page = "<html>" + "é" * 80 + "</html>"
    rows = [(3, "http://a/\r\nx", page), (1, "http://b", page), (2, None, page), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "n", page), (8, "u", page + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest")
    path = write_archive(df)
    got = {r.page_id: r for r in read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        r, raw = got[page_id], (html or "").encode()
        assert bytes(r.payload) == raw and r.payload_digest == hashlib.sha256(raw).hexdigest()
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        if r.record_type == "response":
            assert block == raw + b"\r\n\r\n" and f"Content-Length: {len(raw)}".encode() in head and r.refers_to is None
        else:
            assert block == b"\r\n\r\n" and b"Content-Length: 0" in head and r.refers_to == 1
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {2, 3, None}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    assert read_archive(spark, write_archive(df.where("1 = 0"))).count() == 0


def test_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (7, [1.0, 1.0], 0), (7, [1.0, 1.0], 0), (8, [1.0, 1.0], 0)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 1, 7), (7, 1, 7), (8, 1, 7)]


def test_recall_is_not_claimed_where_nothing_links(spark):
    x = np.random.default_rng(2).normal(size=(300, 64))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.audited_recall for r in got} == {None} and {r.n_links for r in got} == {0}


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=64) + rng.normal(size=(2500, 64)) * 0.02, rng.normal(size=(60, 64))))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 2500} == {(2499, 0)}
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got if r.vec_id >= 2500)


def test_targets_cannot_forge_header_fields(spark):
    html = "<p>" + "x" * 200
    urls = ["http://a/\u2028WARC-Refers-To: <urn:page:77>", "http://b/\u0085WARC-Payload-Digest: sha256:beef", "http://c/\r\nWARC-Type: revisit", "http://d/ü\u2029?q"]
    df = spark.createDataFrame([(i, u, html + str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in read_archive(spark, write_archive(df)).collect()}
    for i, u in enumerate(urls):
        assert (got[i].url, got[i].record_type, got[i].refers_to) == (u.replace("\r", "").replace("\n", ""), "response", None)
        assert got[i].payload_digest == hashlib.sha256((html + str(i)).encode()).hexdigest()


def test_rows_that_share_a_page_id(spark):
    html = "<p>" + "y" * 200
    got = read_archive(spark, write_archive(spark.createDataFrame([(1, "a", html), (1, "b", html), (2, "c", html), (2, "d", "other")], "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to or 0) for r in got) == [(1, "a", "response", 0), (1, "b", "response", 0), (2, "c", "revisit", 1), (2, "d", "response", 0)]
