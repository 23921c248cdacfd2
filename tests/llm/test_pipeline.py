"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as cp
from skywave.llm.bpe import TOKENIZER, tokenizer_path
from skywave.llm.common import stored
from test_mixing import by_hand
from test_text_operators import brute_join

PARTS = {"en": ["the", "ing", "tion", "of", "er", "wh"], "fr": ["le", "eau", "é", "que", "ou"]}


def made(spark, folder, n=260):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 60))]
        junk = i % 9 == 0
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang, rng.choice(["a", "b", "c", None]), 0))
        labels.append((i, int(not junk), 0))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "a", 0) for i in range(40, 60)]
    rows += [(2000, None, "en", "a", 0), (2001, "", None, "b", 0), (2002, "12 34 --", "en", "b", 0), (None, rows[41][1], "en", None, 0), (41, rows[41][1], "en", "c", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rows = made(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, history = docs, {}
    for name, stage in cp.STAGES:
        kept = stored(stage(spark, kept, folder), "test-pipeline")
        history[name] = kept.collect()
        if name != cp.STAGES[-1][0]:
            assert kept.columns == cp.COLUMNS
    quality, language, single, mixed, coded = history.values()

    clean = [r for r in rows if r[0] is not None and r[0] < 260 and r[0] % 9]
    junk = {r[0] for r in rows if r[0] is not None and r[0] < 260 and r[0] % 9 == 0}
    ids = {r.doc_id for r in quality}
    assert sum(r[0] in ids for r in clean) >= 0.95 * len(clean)
    assert len(junk & ids) <= 0.3 * len(junk)

    assert {r.doc_id for r in quality if any(c.isalpha() for c in r.text or "")} >= {r.doc_id for r in language}
    assert not {2000, 2001, 2002} & {r.doc_id for r in language}
    assert sum(r[0] in {x.doc_id for x in language} for r in clean if r[0] in ids) >= 0.98 * len([r for r in clean if r[0] in ids])

    plain = brute_join([(r.doc_id, r.text) for r in language], 5, 80)
    assert {r.doc_id for r in single} == {i for i, _, c, _ in plain if i is None or i == c}

    words = {(r.doc_id, r.text): len(r.text.split()) for r in single}
    size = Counter()
    for r in single:
        size[r.source] += words[r.doc_id, r.text]
    target, taken = by_hand(dict(size)), Counter()
    for r in mixed:
        taken[r.source] += words[r.doc_id, r.text]
    assert all(abs(taken[s] - target[s]) <= 61 for s in target)
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 3

    lib = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    want = Counter()
    for r in mixed:
        x = lib.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in coded) == want
    assert Counter(tuple(r) for r in cp.run(spark, folder).collect()) == want


def test_mixing_takes_rows_not_ids(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None if i % 2 else i // 8, f"w{i} " + "w " * rng.randint(4, 30), "en", ["a", "b", "c", None][i % 4 if i % 5 else 1], 0) for i in range(400)]
    rows += [(None, "same words here", "en", "b", 0)] * 3 + [(None, "", "en", "a", 0), (None, None, "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.mixing(spark, docs, str(tmp_path)).collect()
    have, out, size, taken = Counter(rows), Counter(tuple(r) for r in got), Counter(), Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for r in got:
        taken[r.source] += len((r.text or "").split())
    target = by_hand(dict(size))
    assert all(n <= 3 * have[r] for r, n in out.items())
    assert sum(taken.values()) <= sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 32 for s in target)


def python_operators(plan):
    """The most operators with Python workers that follow one another in one task of a plan."""
    deepest = 0

    def walk(node):
        nonlocal deepest
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.initialPlan())
        below = max((walk(node.children().apply(i)) for i in range(node.children().size())), default=0)
        here = 0 if "Exchange" in name else below + ("Arrow" in name or "Python" in name)
        deepest = max(deepest, here)
        return here

    walk(plan)
    return deepest


def test_encoding_keeps_one_python_worker_a_core(spark, tmp_path):
    """Decoding chained to encoding took two in each task; with check_h's stages after it an executor passed 3000 MB."""
    made(spark, str(tmp_path))
    coded = cp.bpe(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert python_operators(coded._jdf.queryExecution().executedPlan()) == 1
    assert coded.count() == 260 + 20 + 5


def test_language_stage_makes_no_table_of_python_rows(spark, tmp_path, monkeypatch):
    """Such a table starts a daemon and workers of its own on every executor."""
    made(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: (_ for _ in ()).throw(AssertionError("rows of Python")))
    assert cp.language_id(spark, docs, str(tmp_path)).count() >= 200
    assert cp.language_id(spark, docs.where("lang is null"), str(tmp_path)).count() == 0
