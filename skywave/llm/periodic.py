"""Periodic runs: stretches of words that repeat with a period.

A run is a stretch with smallest period q (words q apart are identical) and length >= max(least, 2 * q) which no
neighbouring word extends. Every word of a run occurs in it at least twice, so a word that occurs once in its segment lies
in no run and splits the segment; segments shorter than `least` end. This is repeated until nothing more splits. What is
left is scanned lag by lag. Small lags compare all neighbours at that distance. A larger lag q is compared at checkpoints
only: q equal words in a row hold some whole block of g of them, q/4 < g <= q/2, that begins at a multiple of q - g + 1.
Blocks are compared by hash, and a hit is extended word by word, so hashes decide nothing. Hits inside a run whose period
divides q are skipped: a run there would have that period. Checkpoints of all lags are m * log(m) for m words.

Splitting and scanning stay inside a document, so no rows are exchanged; a task holds the words of SLICE_BYTES of text, or of
one longer document.

Defined cases: null and empty texts have no words and no runs; rows with equal or null ids stay apart; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bytes of text whose words are split together.
SLICE_BYTES = 4 << 20
#: Lags below this compare all words.
SMALL_LAGS = 16
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def split_rare(words: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, segments) of the words left when words that occur once in their segment, and segments shorter than
    `least`, are taken out until nothing changes. Segments number the pieces left, in order."""
    at, segment = np.arange(len(words)), docs.astype(np.int64)
    many = int(words.max(initial=0)) + 1
    while len(at):
        _, which, times = np.unique(segment * many + words[at], return_inverse=True, return_counts=True)
        often = times[which] > 1
        kept, of = at[often], segment[often]
        begins = np.ones(len(kept), bool)
        begins[1:] = (np.diff(kept) > 1) | (np.diff(of) > 0)
        of = np.cumsum(begins) - 1
        long = (np.bincount(of) >= least)[of] if len(of) else np.zeros(0, bool)
        if long.sum() == len(at):
            return kept, of
        at, segment = kept[long], of[long]
    return at, segment


def _stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches of at least `least` true values."""
    ends = np.concatenate(([-1], np.flatnonzero(~equal), [len(equal)]))
    for i in np.flatnonzero(np.diff(ends) > least):
        yield int(ends[i]) + 1, int(ends[i + 1])


def _equal_from(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree, going from i and j (i < j) in the direction of step."""
    room = len(w) - j if step > 0 else i + 1
    done, size = 0, 64
    while done < room:
        n = min(size, room - done)
        a, b = (slice(x + done, x + done + n) if step > 0 else slice(x - done - n + 1, x - done + 1) for x in (i, j))
        other = np.flatnonzero(w[a] != w[b])
        if len(other):
            return done + int(other[0] if step > 0 else n - 1 - other[-1])
        done, size = done + n, size * 2
    return done


def scan_lags(w: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment, by rising period."""
    m = len(w)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period

    for q in range(1, min(SMALL_LAGS - 1, m // 2) + 1):
        for a, b in _stretches(w[:-q] == w[q:], max(least, 2 * q) - q):
            found.setdefault((a, b + q), q)

    g, h = 1, mix64(w.astype(np.uint64) + np.uint64(1))
    for q in range(SMALL_LAGS, m // 2 + 1):
        while 4 * g <= q:
            h = mix64(h[: m - 2 * g + 1] * np.uint64(0x9E3779B97F4A7C15) + h[g:])
            g *= 2
        step = q - g + 1
        hits = np.flatnonzero(h[: m - q - g + 1 : step] == h[q::step]) * step
        if not len(hits):
            continue
        for (a, b), p in found.items():
            if b - a >= q + g and q % p == 0:
                hits = hits[(hits < a) | (hits + q + g > b)]
        passed = -1
        for c in hits.tolist():
            if c < passed:
                continue
            a, passed = c + 1 - _equal_from(w, c, c + q, -1), c + _equal_from(w, c, c + q, 1)
            if passed - a >= max(least, 2 * q) - q:
                found.setdefault((a, passed + q), q)
    return [(a, b - a, q) for (a, b), q in found.items()]


def runs_of(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(begin[-1]))
    at, segment = split_rare(words, np.repeat(np.arange(len(texts)), sizes), least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(segment)) + 1, [len(at)])) if len(at) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        first = int(at[i])
        doc = int(np.searchsorted(begin, first, side="right")) - 1
        out[doc] += [(first - int(begin[doc]) + a, n, q) for a, n, q in scan_lags(words[first : int(at[j - 1]) + 1], least)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ends = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)), dtype=np.int64)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES)))
                words = [t.split() if t else [] for t in texts.slice(i, j - i).to_pylist()]
                runs = runs_of(words, least)
                flat = [x for r in runs for x in r]
                columns = [pa.array(c, pa.int64()) for c in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 3
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN))),
                        pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    schema=_ARROW,
                )
                i = j

    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: every run by start, then period, and the words left when each run
    keeps its first period only."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_find(least), SCHEMA)
