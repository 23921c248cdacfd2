"""Language identification, word first: words known to the model score by their log frequency in each language, other
words by the longest character n-grams of them that are known, and a text by the mean over its words.

The model is fitted on a bounded sample of labelled rows (train_docs of them, of the max_languages labels with most rows,
the same number for each as far as it has rows, chosen by a hash of the id). It keeps about max_words words and max_grams
n-grams, twice that at most, each language its most frequent ones: as many as its part of the sample gives it, an equal
part at least. So stray labels take little room, a rare language keeps its own, and what is sent around is bounded.

Defined cases: null text, or text without letters, is `und` with score 0; rows with a null language or id are not learned
from; without any labelled row everything is `und`; a text that shares nothing with the model gets the first language by
code point; rows with equal ids stay apart; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CACHE_ENTRIES, mix64

#: Labelled rows that the model is fitted on, about (bound of the sample).
TRAIN_DOCS = 10_000
#: Labels that are learned, those with most rows (bound of the sample).
MAX_LANGUAGES = 256
MAX_WORDS = 60_000
MAX_GRAMS = 120_000
MAX_N = 5
#: -log10 of the probability of what a language does not have, beyond its rarest entry.
PENALTY = 1.0
UNKNOWN = "und"
#: A word is letters with the marks that belong to them; digits and numbers of other kinds are no letters.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass
class LanguageModel:
    """Languages, and -log10 relative frequencies of words and n-grams: a row for each entry, a column for each language."""

    languages: list[str]
    words: list[str]
    word_scores: np.ndarray
    gram_keys: np.ndarray
    gram_scores: np.ndarray
    missing: np.ndarray


def gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words with a mark on either side, and the word of each."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    if len(text) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(text) - n + 1, n, np.uint64)
        for j in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + text[j : len(text) - n + 1 + j])
    owner = np.repeat(np.arange(len(words)), size)
    whole = owner[: len(h)] == owner[n - 1 :]
    return h[whole], owner[: len(h)][whole]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of hashed n-grams by language, summed over the task."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(_LETTERS.findall((text or "").lower()))
    for lang, count in words.items():
        known = list(count)
        times = np.fromiter(count.values(), np.int64, len(known))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), pa.nulls(len(known), pa.int64()), pa.array(known, pa.string()), pa.array(times)], names=["lang", "gram", "word", "n"])
        for n in range(1, MAX_N + 1):
            keys, owner = gram_keys(known, n)
            distinct, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, weights=times[owner], minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.view(np.int64)), pa.nulls(len(distinct), pa.string()), pa.array(total)], names=["lang", "gram", "word", "n"])


def sample_sizes(rows: dict[str, int], train_docs: int) -> dict[str, int]:
    """The rows of each language that are learned from: equal numbers, and all rows of languages with fewer."""
    out, left = {}, train_docs
    for i, (lang, n) in enumerate(sorted(rows.items(), key=lambda r: (r[1], r[0]))):
        out[lang] = min(n, left // (len(rows) - i))
        left -= out[lang]
    return out


def fit_language_model(labelled: DataFrame, *, train_docs: int = TRAIN_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fit on (id, lang, text) rows without null id or lang: on about train_docs of them, dealt over the languages."""
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()}
    sizes = {lang: n for lang, n in sample_sizes(rows, train_docs).items() if n}
    room = {lang: max(n / sum(sizes.values()), 1 / len(sizes)) for lang, n in sizes.items()}
    # through Arrow it is a local table; rows of Python would start workers of their own on the executors
    shares = [pa.array(list(sizes), pa.string()), pa.array([n / rows[lang] for lang, n in sizes.items()], pa.float64()), pa.array(list(room.values()), pa.float64())]
    take = labelled.sparkSession.createDataFrame(pa.Table.from_arrays(shares, names=["tl", "share", "room"]))
    sample = labelled.join(F.broadcast(take), labelled.lang == take.tl).where(F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, word string, n long").groupBy("lang", "gram", "word").agg(F.sum("n").alias("n"))
    top = {}
    for kind, limit in (("word", max_words), ("gram", max_grams)):
        by = counts.where(F.col(kind).isNotNull()).select("lang", F.col(kind).alias("key"), "n")
        # bounded: the counts are those of the sample
        ranked = by.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")))
        fits = F.col("nth") <= F.floor(F.col("room") * limit)
        ranked = ranked.join(F.broadcast(take), ranked.lang == take.tl)  # max_languages rows
        kept = ranked.withColumn("fits", F.max(fits).over(Window.partitionBy("key"))).where("fits")
        top[kind] = kept.select("key", "lang", "n").toArrow()  # in columns: rows of objects would fill the driver
    languages = sorted({x for t in top.values() for x in pc.unique(t.column("lang")).to_pylist()})
    column = pa.array(languages, pa.string())
    scores, entries = {}, {}
    for kind, t in top.items():
        t = t.sort_by([("key", "ascending"), ("lang", "ascending")])
        coded = t.column("key").combine_chunks().dictionary_encode()
        entries[kind] = coded.dictionary
        n = np.zeros((len(coded.dictionary), len(languages)))
        if t.num_rows:
            np.add.at(n, (coded.indices.to_numpy(), pc.index_in(t.column("lang"), column).to_numpy()), t.column("n").to_numpy())
        with np.errstate(divide="ignore"):
            s = -np.log10(n / np.maximum(n.sum(0), 1)) if len(n) else n
        worst = np.where(np.isfinite(s), s, 0).max(initial=0) + PENALTY
        scores[kind] = (np.where(np.isfinite(s), s, worst).astype(np.float32), worst)
    keys = entries["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return LanguageModel(languages, entries["word"].to_pylist(), scores["word"][0], keys[order], scores["gram"][0][order], np.full(len(languages), max(scores["word"][1], scores["gram"][1]), np.float32))


def score_words(words: list[str], model: LanguageModel, known: dict[str, int]) -> np.ndarray:
    """A row of scores for each word: its own where it is known, else the mean over its longest known n-grams."""
    out = np.tile(model.missing, (len(words), 1))
    rows = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
    out[rows >= 0] = model.word_scores[rows[rows >= 0]]
    left = np.flatnonzero(rows < 0)
    for n in range(MAX_N, 0, -1):
        if not len(left) or not len(model.gram_keys):
            break
        keys, owner = gram_keys([words[i] for i in left], n)
        at = np.minimum(np.searchsorted(model.gram_keys, keys), len(model.gram_keys) - 1)
        hit = model.gram_keys[at] == keys
        found = np.bincount(owner[hit], minlength=len(left))
        some = found > 0
        for c in range(len(model.languages)):
            total = np.bincount(owner[hit], weights=model.gram_scores[at[hit], c], minlength=len(left))
            out[left[some], c] = (total[some] / found[some]).astype(np.float32)
        left = left[~some]
    return out


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(model.words)}
        width = len(model.languages)
        number: dict[str, int] = {}  # of each string between spaces
        sums, letters = np.zeros((1 << 16, width), np.float32), np.zeros(1 << 16, np.int32)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                if len(number) >= CACHE_ENTRIES:
                    number.clear()
                new = len(number)
                codes = []
                for text in batch.column(1).to_pylist():
                    tokens = text.lower().split() if text else []
                    codes.append(np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens)))
                fresh = list(number)[new:] if len(number) > new else []
                while len(sums) < len(number):
                    sums, letters = np.concatenate((sums, np.zeros_like(sums))), np.concatenate((letters, np.zeros_like(letters)))
                parts = [_LETTERS.findall(t) for t in fresh]
                owner = np.repeat(np.arange(len(fresh)), [len(p) for p in parts])
                words = [w for p in parts for w in p]
                if fresh:
                    scored = score_words(words, model, known) if words else np.zeros((0, width), np.float32)
                    letters[new : new + len(fresh)] = np.bincount(owner, minlength=len(fresh))
                    for c in range(width):
                        sums[new : new + len(fresh), c] = np.bincount(owner, weights=scored[:, c], minlength=len(fresh))
                lang, score = [], []
                for code in codes:
                    n = int(letters[code].sum())
                    if not n or not width:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    mean = sums[code].sum(0, dtype=np.float64) / n
                    best = int(mean.argmin())
                    lang.append(model.languages[best])
                    score.append(float(1 / np.power(10.0, mean[best] - mean).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(id_col: str, parts: int, part: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def predict_language(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; score is the predicted language's share of the likelihoods by word."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the labelled rows outside the held-out quarter."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4)).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    model = fit_language_model(labelled, train_docs=train_docs)
    return predict_language(df, model, id_col, text_col).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
