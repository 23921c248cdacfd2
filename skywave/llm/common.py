"""Shared pieces of the corpus operators: shared folders, hashing, connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from skywave.operators.links import connected_components
from skywave.sources.tables import shared_dir, stored

__all__ = ["CACHE_ENTRIES", "WordHashes", "ascii_words", "connected_components", "mix64", "shared_dir", "shingle_set", "stored", "table"]

#: Entries that a worker keeps in a cache of words before it starts afresh.
CACHE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """bytes -> 64-bit hash, computed once for each word while the cache has room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES:
            self[word] = h
        return h


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; bytes.lower and bytes.split treat just these bytes."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, no words none."""
    words = ascii_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < k:
            s = np.array([n], np.uint64)
            for j in range(n):
                s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
        else:
            s = np.full(n - k + 1, k + 1000, np.uint64)
            for j in range(k):
                s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
