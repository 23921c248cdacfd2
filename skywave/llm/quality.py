"""Quality selection by importance resampling.

Two generative models over hashed n-grams (runs of letters and digits and runs of signs, single and in pairs) are counted: the target's, on
labelled rows of good quality, and the raw one, on all rows. A document's importance is the log-ratio of the two, averaged
over its n-grams, times `scale`. Gumbel noise, drawn from a hash of the id, is added, and the top k documents are taken: a
draw of k documents without replacement, where exp(importance) is a document's weight. So the choice falls with the
importance, sharply for a large scale; documents near the edge are drawn by their weights, and another seed draws others.

k is a share of the rows if one is given. Otherwise it is the number of documents whose importance reaches what all but a
small share of the labelled good rows reach (rows that the target was not fitted on): as many as are good by the labels, so
that clean documents stay. Exactly k rows are taken, ties by smaller id (null last); rows that agree in score and id stay or
go together.

A piece that follows itself is one class n-gram whatever the piece: a bounded target meets single ones too rarely.

The labels are a bounded sample (train_docs of them, by a hash of the id), so they can be broadcast; raw counts and the
k-th score cover all rows. The k-th score is found by narrowing a histogram of counts, not by sorting.

Defined cases: null and empty texts have no n-grams and importance 0; a null id gets the noise of an empty id; several labels
of one id count as good only if all are; without any good label the importance is 0 and every row is kept, unless a share
is given; rows with equal ids stay apart; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, mix64, stored

BUCKETS = 10_000
_PIECE = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")
#: Labelled rows that the target is fitted on, about (bound of the sample).
TRAIN_DOCS = 20_000
#: Share of the labelled good rows that may fall below the chosen score.
LOSS = 0.002
#: What the mean log-ratio of an n-gram is multiplied by, beside noise of standard deviation 1.28.
SCALE = 200.0
#: Counts that every bucket of a model has at the start.
PRIOR = 1.0


class Pieces(dict):
    """The hashes of the runs of letters or signs in a word, worked out once while there is room."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        got = tuple(map(xxhash.xxh3_64_intdigest, _PIECE.findall(word)))
        if len(self) < CACHE_ENTRIES:
            self[word] = got
        return got


def ngram_buckets(text: bytes | None, cache: Pieces) -> np.ndarray:
    """Buckets of the single pieces and the pairs of neighbouring pieces of a text."""
    h = np.array([*chain.from_iterable(map(cache.__getitem__, text.split()))], np.uint64) if text else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        pairs[h[:-1] == h[1:]] = 1  # a piece that follows itself is one n-gram, whichever it is
    return (np.concatenate((h, pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bucket over a task's documents: of all, and of those marked good."""
    cache = Pieces()
    counts = np.zeros((2, BUCKETS), np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            found = [ngram_buckets(t, cache) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            good = [f for f, g in zip(found, batch.column(1).to_pylist(), strict=True) if g]
            for row, some in zip(counts, (found, good), strict=True):
                row += np.bincount(np.concatenate([np.empty(0, np.int64), *some]), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])], names=["bucket", "raw", "target"])


def good_labels(labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(label_id, good, fitted) of a bounded sample of the labelled rows (doc_id, quality), one row for each id.

    The model is fitted on the rows marked so; the others set the score to reach.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    share = min(1.0, train_docs / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    one = picked.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("quality") == 1).alias("good"))
    return one.withColumn("fitted", F.pmod(F.xxhash64("label_id", F.lit(12)), F.lit(10)) < 7)


def importance_model(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """log(target / raw) for each bucket, from (doc_id, text) and (label_id, good, fitted); None without a good label."""
    # the labels are a sample of bounded size
    marked = docs.join(F.broadcast(labels), docs.doc_id == labels.label_id, "left").select("text", F.coalesce(F.col("good") & F.col("fitted"), F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, PRIOR), np.full(BUCKETS, PRIOR)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    if not counts["target"].sum():
        return None
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _score(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Pieces()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                sizes, sums = [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    found = ngram_buckets(text, cache)  # of one document at a time
                    sizes.append(len(found))
                    sums.append(float(model[found].sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "n_ngrams", "log_ratio"])

    return run


def kth_largest(scores: DataFrame, column: str, k: int, *, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest value of a column without sorting it: the range that holds it shrinks by `bins` with each pass."""
    low, high, count = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or count < k:
        return None
    inside, rank = scores, k
    while count > few and low < high:
        width = (high - low) / bins
        if not low + width > low:
            break
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        hist = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in hist:
            if rank <= r["n"]:
                low, high, count = r["lo"], r["hi"], r["n"]
                break
            rank -= r["n"]
        inside = scores.where(F.col(column).between(low, high))
    if low == high:
        return low
    return inside.select(column).orderBy(F.col(column).desc()).limit(rank).agg(F.min(column)).first()[0]


def gumbel(id_col: str, seed: int) -> F.col:
    """Gumbel noise from a hash of the id: the same on every run."""
    u = (F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def top_k(scores: DataFrame, k: int) -> F.col:
    """Whether a row of (doc_id, score) is among the k of greatest score, ties by smaller doc_id, null last."""
    cut = kth_largest(scores, "score", k)
    if cut is None:
        return F.lit(k > 0)
    above = scores.where(F.col("score") > F.lit(cut)).count()
    # ids as numbers that fall with the id exceed 2^53: the order of the ties is found in two halves
    tied = scores.where(F.col("score") == F.lit(cut)).select((-F.shiftright("doc_id", 32)).cast("double").alias("high"), (-F.col("doc_id").bitwiseAND(F.lit((1 << 32) - 1))).cast("double").alias("low"))
    high = kth_largest(tied, "high", k - above)
    if high is None:  # only null ids are left to take
        return F.col("score") >= F.lit(cut)
    over = tied.where(F.col("high") > F.lit(high)).count()
    low = kth_largest(tied.where(F.col("high") == F.lit(high)), "low", k - above - over)
    last = -int(high) * (1 << 32) - int(low)
    return (F.col("score") > F.lit(cut)) | F.coalesce((F.col("score") == F.lit(cut)) & (F.col("doc_id") <= F.lit(last)), F.lit(False))


def quality_select(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, train_docs: int = TRAIN_DOCS, share: float | None = None, loss: float = LOSS, scale: float = SCALE, seed: int = 8
) -> DataFrame:
    """(doc_id, n_ngrams, log_ratio, importance, score, kept) for each row; labels has doc_id and quality (1 is good).

    share: part of the rows to draw; None takes as many as are good by the labels, which `loss` of the good ones may miss.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    good = stored(good_labels(labels, train_docs), "quality-labels")
    model = importance_model(docs, good)
    scores = docs.mapInArrow(_score(np.zeros(BUCKETS) if model is None else model), "doc_id long, n_ngrams long, log_ratio double")
    scores = scores.withColumn("importance", F.lit(scale) * F.col("log_ratio") / F.greatest("n_ngrams", F.lit(1)))
    scores = stored(scores.withColumn("score", F.col("importance") + gumbel("doc_id", seed)), "quality-scores")
    if share is not None:
        k = round(share * scores.count())
    else:
        labelled = scores.join(F.broadcast(good.where("good and not fitted")), scores.doc_id == good.label_id, "left_semi")
        least = labelled.agg(F.percentile("importance", F.lit(loss))).first()[0]
        k = scores.count() if least is None or model is None else scores.where(F.col("importance") >= F.lit(least)).count()
    return scores.withColumn("kept", top_k(scores, k))
