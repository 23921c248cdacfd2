"""Token counts without token ids.

Each task makes one block: a dictionary of the pre-tokens in its documents, numbered as they come, and each document's
pre-token frequencies by those numbers. Dictionaries are dealt by pre-token, so all occurrences of one meet in one place,
where its pieces are counted once. The counts go back to their blocks, and each document's total is a sum over its
frequencies.

Defined cases: null text is empty: 0 bytes, 0 tokens; rows with equal or null ids stay apart; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, WordBpe

#: Entries of its dictionary, or bytes of its documents, at which a block closes, which bounds a worker's memory.
BLOCK_ENTRIES = 300_000
BLOCK_BYTES = 64 << 20
_BLOCKS = "block long, doc_id long, n_bytes long, extra long, entries binary, freqs binary, number int, pretoken string"
_ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("extra", pa.int64()), ("entries", pa.binary()), ("freqs", pa.binary()), ("number", pa.int32()), ("pretoken", pa.string())]
)


def planes(x: np.ndarray) -> bytes:
    """Little numbers as bytes, all lowest bytes first: the many zero bytes then lie together."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _blocks(name: str, docs_only: bool, block_entries: int):
    """Rows of documents, or rows of dictionary entries: the same input gives the same numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(name)
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 24
        numbers: dict[str, int] = {}
        words: dict[str, tuple[int, ...]] = {}
        held = 0

        def number(p: str) -> int:
            return numbers.setdefault(p, len(numbers))

        def dictionary() -> pa.RecordBatch:
            n = len(numbers)
            null = lambda t: pa.nulls(n, t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.binary()), null(pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.string())], schema=_ARROW)

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n_bytes, extra, entries, freqs = [], [], [], []
                for text in batch.column(1).to_pylist():
                    found: list[int] = []
                    specials = 0
                    for part in bpe.segments(text or ""):
                        if part in bpe.special:
                            specials += 1
                        elif bpe.is_plain(part):
                            for w in part.split():
                                got = words.get(w)
                                if got is None:
                                    got = words[w] = tuple(number(p) for p in bpe.pretokens(w))
                                found += got
                        else:
                            found += [number(p) for p in bpe.pretokens(part)]
                    n_bytes.append(len((text or "").encode()))
                    extra.append(specials)
                    if docs_only:
                        e, f = np.unique(np.array(found, np.int64), return_counts=True)
                        entries.append(planes(np.diff(e, prepend=0)))
                        freqs.append(planes(f))
                if docs_only:
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(extra, pa.int64()), pa.array(entries, pa.binary()), pa.array(freqs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_ARROW)
                held += sum(n_bytes)
                if len(numbers) >= block_entries or held >= BLOCK_BYTES:
                    if not docs_only:
                        yield dictionary()
                    block += 1
                    held = 0
                    numbers.clear()
                    words.clear()
        if not docs_only:
            yield dictionary()

    return run


def _count_pieces(name: str):
    """Sorted rows of pre-tokens -> the number of pieces of each, counted once for each run of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(name)
        last, count = None, 0
        for batch in batches:
            out = []
            for p in batch.column(2).to_pylist():
                if p != last:
                    last, count = p, len(bpe.closed.tokenize(bpe.mapped(p)))
                out.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["cblock", "number", "pieces"])

    return run


def _sum_block(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
    pieces = np.zeros(counts.num_rows, np.int64)
    pieces[counts.column("number").to_numpy()] = counts.column("pieces").to_numpy()
    totals = [
        int((pieces[np.cumsum(unplanes(e), dtype=np.int64)] * unplanes(f)).sum()) + x
        for e, f, x in zip(docs.column("entries").to_pylist(), docs.column("freqs").to_pylist(), docs.column("extra").to_pylist(), strict=True)
    ]
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_bytes": docs.column("n_bytes").cast(pa.int64()), "n_tokens": pa.array(totals, pa.int64())})


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = TOKENIZER, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of df, a table scan or stored rows (they are read twice, in the same order)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequencies = docs.mapInArrow(_blocks(tokenizer, True, block_entries), _BLOCKS).select("block", "doc_id", "n_bytes", "extra", "entries", "freqs")
    entries = docs.mapInArrow(_blocks(tokenizer, False, block_entries), _BLOCKS).select("block", "number", "pretoken")
    counts = entries.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(_count_pieces(tokenizer), "cblock long, number int, pieces int")
    return frequencies.groupBy("block").cogroup(counts.groupBy("cblock")).applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long")
