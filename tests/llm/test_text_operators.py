import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from skywave.llm import bpe, hmm, lang_id, quality
from skywave.llm.common import mix64
from skywave.llm.ngram_join import allocate, band_difference, ngram_join
from skywave.llm.token_counts import token_counts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))


ODD = [
    (1, "Hello World, it's 2024!"), (2, None), (3, ""), (4, "a" * 9000 + " x <|endoftext|> " + "Ünïcode “quotes” 日本語 " * 30), (4, "ab" * 5000 + "!?" * 3000),
    (None, "İstanbul ΑΣ ﬁ é x y\x1cz it's don'T"), (7, "<|startoftext|>x<|endoftext|>"), (8, "Ñandú " * 5 + "ñ" * 5000 + " end"), (9, "   \n\t "), (9, "   \n\t "),
]
SCHEMA = "doc_id long, text string, ids string"


def odd(spark):
    return spark.createDataFrame([(a, b, "clash") for a, b in ODD], SCHEMA)


@pytest.mark.parametrize("limit", [4096, 64])
def test_encode_and_decode_match_the_library(spark, limit):
    lib = library()
    got = bpe.decode(bpe.encode(odd(spark), run_limit=limit)).collect()
    want = [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in ODD]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), x) for i, x in want)
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), lib.decode(x, skip_special_tokens=False)) for i, x in want)


def test_tree_concatenation_equals_whole_encoding():
    random.seed(3)
    b = bpe.WordBpe(bpe.TOKENIZER)
    for _ in range(300):
        text = "".join(random.choice(random.choice(["ab", "aeiorst", "abcdefghijklmnopqrstuvwxyz", "!?."])) for _ in range(random.randint(30, 300)))
        text = "".join(c for c in text if c.isalpha()) or "ab"
        size = random.choice([5, 17, 40])
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        pieces = [(p, *bpe.encode_piece(p, i + 1 == len(parts), b)) for i, p in enumerate(parts)]
        assert bpe.tree_concat(pieces, b) == [t.id for t in b.closed.tokenize(text)]


def test_token_counts_match_the_library(spark):
    lib = library()
    for entries in (300_000, 5):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(odd(spark), block_entries=entries).collect())
        assert got == sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert token_counts(odd(spark).where("1 = 0")).count() == 0


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_join(rows, k, percent):
    sets = [shingles(t, k) if i is not None else set() for i, t in rows]
    root, links = {i: i for i, _ in rows if i is not None}, [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                links[x] += 1
                links[y] += 1
                a, b = find(rows[x][0]), find(rows[y][0])
                root[max(a, b)] = min(a, b)
    return [(i, len(shingles(t, k)), None if i is None else find(i), n) for (i, t), n in zip(rows, links, strict=True)]


@pytest.mark.parametrize("k,percent,deletions", [(3, 90, None), (3, 90, 99), (5, 80, None)])
def test_ngram_join_matches_brute_force(spark, k, percent, deletions):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 9, 12, 30, 120, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "One"), (503, "one"), (504, "ONE two"), (505, rows[0][1] + " " + rows[9][1]), (506, "é " * 50), (None, rows[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join(df, k=k, percent=percent, deletions=deletions).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute_join(rows, k, percent), key=key)


def test_allocation_keeps_its_units():
    for percent in (80, 90):
        for band in range(8, 40):
            for d in (None, 0, 2, 50):
                a = allocate(band, percent, d)
                if a:
                    assert a.segments + a.deletions == band_difference(band, percent) + 1 + a.spare


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def corpus(spark, n=240):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "tion", "of", "er", "wh"], "fr": ["le", "eau", "é", "que", "ou"], "de": ["der", "sch", "ung", "ü", "keit"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_id_on_held_out_rows(spark):
    rows = corpus(spark) + [(900, None, "en"), (901, "123 !!", "fr"), (902, "", None), (None, "der schung", "de"), (903, "日本語", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = lang_id.language_id(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in lang_id.language_id(df.where("lang is null")).collect()} == {"und"}


def test_language_id_matches_a_plain_version(spark):
    import regex

    rows = corpus(spark, 90) + [(900, "²½ ①", "en"), (901, "क्या है", None), (902, "the थe x1y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    train = [r for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = sorted({r[2] for r in train})
    words, grams = Counter(), Counter()
    for _, text, lang in train:
        for w in letters.findall(text.lower()):
            words[w, lang] += 1
            for n in range(1, 6):
                for j in range(len(w) + 3 - n):
                    grams[f"\2{w}\3"[j : j + n], lang] += 1

    def table(counts):
        total = Counter()
        for (_, lang), n in counts.items():
            total[lang] += n
        found = {key: -math.log10(n / total[key[1]]) for key, n in counts.items()}
        worst = max(found.values()) + lang_id.PENALTY
        return {e: [found.get((e, lang), worst) for lang in langs] for e in {e for e, _ in counts}}, worst

    known, worst_word = table(words)
    pieces, worst_gram = table(grams)

    def scores(w):
        if w in known:
            return known[w]
        for n in range(5, 0, -1):
            hit = [pieces[g] for g in (f"\2{w}\3"[j : j + n] for j in range(len(w) + 3 - n)) if g in pieces]
            if hit:
                return np.mean(hit, 0)
        return [max(worst_word, worst_gram)] * len(langs)

    for r in lang_id.language_id(df).collect():
        found = letters.findall(next(t for i, t, _ in rows if i == r.doc_id).lower())
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = np.mean([scores(w) for w in found], 0)
        assert r.lang_pred == langs[int(np.argmin(mean))] and math.isclose(r.score, 1 / sum(10 ** (mean.min() - mean)), rel_tol=1e-3)


def test_rare_languages_keep_their_rows_and_words(spark):
    assert lang_id.sample_sizes({"en": 1000, "is": 5, "fr": 40}, 90) == {"is": 5, "fr": 40, "en": 45}
    rows = [(i, f"common word{i % 50} the of", "en") for i in range(400)] + [(1000 + i, "þetta er íslenska", "is") for i in range(8)]
    model = lang_id.fit_language_model(spark.createDataFrame(rows, "id long, text string, lang string"), train_docs=100, max_words=20, max_grams=400)
    assert model.languages == ["en", "is"] and {"þetta", "er", "íslenska"} <= set(model.words) and len(model.words) <= 2 * 20


def test_stray_labels_leave_room_for_languages(spark):
    rows = [(i, f"common word{i % 50} the of", "en") for i in range(400)] + [(1000 + i, "þetta er íslenska", "is") for i in range(400)] + [(5000 + i, f"stray{i}", f"label{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit_language_model(df.withColumnRenamed("doc_id", "id"), train_docs=900, max_words=100, max_grams=2000)
    assert len(model.languages) <= lang_id.MAX_LANGUAGES and {"the", "of", "þetta", "er", "íslenska"} <= set(model.words) and len(model.words) <= 200
    got = {r.doc_id: r.lang_pred for r in lang_id.language_id(df).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:800]) and len(got) == len(rows)


def test_quality_keeps_good_and_rejects_most_junk(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        junk = i % 8 == 0
        words = ["".join(rng.choice(["the", "ing", "er"]) for _ in range(3)) for _ in range(40)]
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words)))
        if i % 3:
            labels.append((i, int(not junk), 0))
    rows += [(None, "the ing"), (700, None), (700, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_select(df, lab).collect()
    assert len(got) == len(rows)
    bad = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 8 == 0]
    good = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 8]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert all(r.kept for r in quality.quality_select(df, lab.where("1 = 0")).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=3000), np.zeros(500), rng.normal(size=500) * 1e6))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 17, 1999, 4000):
        assert quality.kth_largest(df, "v", k, bins=16, few=50) == np.sort(x)[::-1][k - 1]
    assert quality.kth_largest(df, "v", 5000) is None


def spark_hash(*values):
    """The 64-bit hash of longs and ints in a row, signed."""
    h = 42
    for v, kind in values:
        h = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_selection(rows, labels, seed, loss, share=None):
    """The whole of quality_select in plain Python: n-grams, counts, importance, noise, k and the k greatest."""

    def ngrams(text):
        pieces = [re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+", w) for w in (text or "").encode().split()]
        h = np.array([xxhash.xxh3_64_intdigest(p) for w in pieces for p in w], np.uint64)
        with np.errstate(over="ignore"):
            pairs = [1 if a == b else int(mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)) for a, b in zip(h[:-1], h[1:], strict=True)]
        return [int(x) % quality.BUCKETS for x in [*h, *pairs]]

    good = {}
    for i, q in labels:
        good[i] = min(good.get(i, 1), q)
    fitted = {i for i, q in good.items() if q and spark_hash((i, "q"), (12, "i")) % 10 < 7}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(ngrams(t))
        if i in fitted:
            target.update(ngrams(t))
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    out = []
    for i, t in rows:
        g = ngrams(t)
        ratio = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in g)
        importance = quality.SCALE * ratio / max(1, len(g))
        u = (spark_hash((i or 0, "q"), (seed, "i")) % (1 << 52) + 0.5) / (1 << 52)
        out.append((i, len(g), ratio, importance, importance - math.log(-math.log(u))))
    held = sorted(o[3] for o in out if good.get(o[0]) and o[0] not in fitted)
    k = round(share * len(rows)) if share is not None else sum(o[3] >= np.quantile(held, loss) - 1e-9 for o in out)
    order = sorted(out, key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    return out, k, {o[0] for o in order[:k]}


def mixed_quality(n=240):
    rng = random.Random(8)
    good = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        share = rng.choice([0.0, 0.0, 0.45, 0.5, 0.55, 1.0])  # of junk
        rows.append((i, " ".join(rng.choice("$$$ @@@ %%% ^^^".split()) if rng.random() < share else rng.choice(good) for _ in range(rng.randint(5, 60)))))
        if rng.random() < 0.6:
            labels.append((i, int(share < 0.5)))
    return rows, labels


def test_quality_selection_matches_the_plain_computation(spark):
    rows, labels = mixed_quality()
    rows += [(900, None), (901, ""), (None, "w1 w2 $$$"), (902, "w3 w4 " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, score string, kept boolean")
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int")
    chosen = {}
    for seed, share in ((8, None), (9, None), (8, 0.3)):
        want, k, kept = plain_selection(rows, labels, seed, 0.2, share)
        got = quality.quality_select(df, lab, loss=0.2, seed=seed, share=share).collect()
        by_id = {r.doc_id: r for r in got}
        assert len(got) == len(rows)
        for i, n, ratio, importance, score in want:
            r = by_id[i]
            assert r.n_ngrams == n and np.allclose([r.log_ratio, r.importance, r.score], [ratio, importance, score], rtol=1e-9, atol=1e-7)
        assert sum(r.kept for r in got) == k == len(kept) and {r.doc_id for r in got if r.kept} == kept
        chosen[seed, share] = kept
    assert chosen[8, None] != chosen[9, None] and len(chosen[8, None]) == len(chosen[9, None])
    assert quality.quality_select(df.where("1 = 0"), lab).count() == 0


def test_draws_follow_the_weights_and_take_exactly_k(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN ln(3.0D) ELSE 0.0D END AS importance")
    for seed in (1, 2):
        d = df.withColumn("score", df.importance + quality.gumbel("doc_id", seed))
        taken = d.where(quality.top_k(d, 400)).selectExpr("count(*) AS n", "sum(int(doc_id % 2 = 0)) AS heavy").first()
        assert taken.n == 400 and 0.68 < taken.heavy / 400 < 0.8  # three to one, less what is used up
    tied = spark.createDataFrame([(i, 1.0) for i in [5, -3, 1 << 40, (1 << 40) + 1, None, 7]] + [(99, 2.0)], "doc_id long, score double")
    for k, ids in ((1, {99}), (3, {99, -3, 5}), (5, {99, -3, 5, 7, 1 << 40}), (7, {99, -3, 5, 7, 1 << 40, (1 << 40) + 1, None}), (0, set())):
        assert {r.doc_id for r in tied.where(quality.top_k(tied, k)).collect()} == ids


def test_forward_recursion_and_counts():
    import itertools

    rng = np.random.default_rng(0)
    k, c = 3, 5
    m = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    docs = [rng.integers(0, c, n) for n in (1, 4, 6, 2, 6)]

    def by_paths(d):
        total = 0
        for p in itertools.product(range(k), repeat=len(d)):
            x = m.start[p[0]] * m.emit[p[0], d[0]]
            for a, b, o in zip(p, p[1:], d[1:], strict=False):
                x *= m.move[a, b] * m.emit[b, o]
            total += x
        return math.log10(total)

    got, starts, moves, emits = hmm.forward_backward(docs, m, True)
    assert np.allclose(got, [by_paths(d) for d in docs])
    assert np.isclose(starts.sum(), 5) and np.isclose(moves.sum(), 14) and np.isclose(emits.sum(), 19)
    assert np.allclose(emits.sum(0), np.bincount(np.concatenate(docs), minlength=c))


def test_long_sequences_in_pieces():
    rng = np.random.default_rng(3)
    m = hmm.Hmm(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4))
    for n in (1, 5, 40, 41):
        d = rng.integers(0, 9, n)
        for piece in (1, 7, 40, 100):
            for one, whole in zip(hmm.long_forward_backward(d, m, True, piece), hmm.forward_backward([d], m, True), strict=True):
                assert np.allclose(one, whole)


def test_update_step_by_hand(spark):
    rng = np.random.default_rng(6)
    k, c = 2, 4
    m = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    docs = [rng.integers(0, c, n) for n in (3, 1, 5, 4)]
    start, move, emit = np.full(k, hmm.SMOOTHING), np.full((k, k), hmm.SMOOTHING), np.full((k, c), hmm.SMOOTHING)
    import itertools

    for d in docs:  # expected counts by all paths
        paths = list(itertools.product(range(k), repeat=len(d)))
        p = np.array([m.start[s[0]] * math.prod(m.emit[a, o] for a, o in zip(s, d, strict=True)) * math.prod(m.move[a, b] for a, b in zip(s, s[1:], strict=False)) for s in paths])
        for s, w in zip(paths, p / p.sum(), strict=True):
            start[s[0]] += w
            for a, o in zip(s, d, strict=True):
                emit[a, o] += w
            for a, b in zip(s, s[1:], strict=False):
                move[a, b] += w
    rows = [(True, bytes(np.ascontiguousarray(d.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes())) for d in docs]
    got = hmm.baum_welch_pass(spark.createDataFrame([*rows, (False, rows[0][1])], "train boolean, classes binary").repartition(3), m)
    for a, b in ((got.start, start / start.sum()), (got.move, move / move.sum(1, keepdims=True)), (got.emit, emit / emit.sum(1, keepdims=True))):
        assert np.allclose(a, b)


def test_scores_do_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t, _ in corpus(spark, 200)], "doc_id long, text string")
    a, b = (sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 9), round(r.score, 6)) for r in hmm.hmm_scores(df.repartition(n), states=4, top_words=50, suffix_classes=30, start_docs=60).collect()) for n in (2, 7))
    assert a == b


def test_hmm_scores_against_counts(spark):
    rows = [(i, t) for i, t, _ in corpus(spark, 150)] + [(900, None), (901, ""), (None, "the The THE")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = hmm.hmm_scores(df, states=3, top_words=20, suffix_classes=30, block_entries=40).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = {i: (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert math.isclose(r.base_score, want[r.doc_id][2], rel_tol=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert hmm.hmm_scores(df.where("1 = 0")).count() == 0


def test_digests_of_op2(spark):
    text = "Round trip"
    lib = library()
    ids = lib.encode(text, add_special_tokens=False).ids
    r = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
