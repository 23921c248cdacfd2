from skywave.llm.mixing import mix, source_targets


def by_hand(sizes, weights=(5, 2, 1), most=3):
    """Share, cap, share the excess again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, capped = {}, set()
    total = sum(sizes.values())
    while True:
        free = [n for n in names if n not in capped]
        rest = total - sum(most * sizes[n] for n in capped)
        target = {n: most * sizes[n] for n in capped} | {n: rest * w[n] / sum(w[m] for m in free) for n in free}
        above = [n for n in free if target[n] > most * sizes[n]]
        if not above:
            return target
        capped |= set(above)


def test_targets_follow_resharing(spark):
    for sizes in ({"a": 10, "b": 500, "c": 30, None: 7}, {"a": 1, "b": 1, "c": 1000}, {"x": 5}, {"a": 0, "b": 3}, {f"s{i:02d}": (i * 37) % 100 + (900 if i == 3 else 1) for i in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = by_hand(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix_near_targets_and_bounds(spark):
    rows = [(i, " ".join(["w"] * (i % 13 + 1)), ["a", "b", "c", None][i % 4 if i % 7 else 1]) for i in range(800)]
    rows += [(900, None, "a"), (901, "", "z"), (None, "x y", "b"), (3, "again", "c"), (3, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    got = mix(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 14 for s in target)
    assert sum(taken.values()) <= sum(r.size for r in got)
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, size string")
    assert mix(df).count() == 0
