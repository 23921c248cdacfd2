"""Scoring texts with a hidden Markov language model.

Words are counted exactly over all training documents. A text is a sequence of word classes: the end of the text, each of
the most frequent words by itself, and for other words a class by their last letters. The hidden Markov model emits the
classes; inside a class a word has its add-one share of the class's counts. Baum-Welch passes compute expected counts in
every partition, which are summed across partitions; the scaled forward recursion then gives the exact log-likelihood.

To count and to look up counts without moving texts, each task makes a block: a dictionary of its words, and each
document as numbers in it. Dictionaries are dealt by word and counted; the counts return to their blocks.

Bounded by parameters: the class vocabulary (top_words, suffix_classes), the states, and the start_docs documents from
which the passes start (a starting point only: every pass counts all training documents).

Defined cases: null text is empty, which is the end alone; a null id is not held out; rows with equal or null ids stay
apart; extra columns are ignored; without training documents the counts are zero and the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_words, stored
from .lang_id import held_out
from .token_counts import planes, unplanes

STATES = 8
TOP_WORDS = 4000
SUFFIX_CLASSES = 2000
PASSES = 2
START_DOCS = 600
#: A block closes at so many words of its dictionary, or so many tokens of its documents.
BLOCK_ENTRIES = 400_000
BLOCK_TOKENS = 16_000_000
#: Tokens whose forward probabilities a worker holds at a time.
CHUNK_TOKENS = 300_000
#: Added to every expected emission and transition count.
SMOOTHING = 0.05
END = "\n"  # no word holds white space


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row for each state, a column for each class


def _blocks(docs_only: bool, block_entries: int):
    """Documents as numbers of a block's dictionary, or the dictionary's entries with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 24
        numbers: dict[bytes, int] = {END.encode(): 0}
        counts = np.zeros(1 << 16, np.int64)
        held = 0

        def dictionary() -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.binary()).cast(pa.string()), pa.array(counts[:n])], names=["block", "number", "word", "c"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                codes, tokens, train = [], [], batch.column(2).to_pylist()
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    words = ascii_words(text)
                    tokens.append(len(words) + 1)
                    codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
                while len(counts) < len(numbers):
                    counts = np.concatenate((counts, np.zeros_like(counts)))
                if docs_only:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), batch.column(0), batch.column(2), pa.array([planes(c) for c in codes], pa.binary())], names=["block", "doc_id", "train", "codes"])
                else:
                    learned = [c for c, t in zip(codes, train, strict=True) if t]
                    if learned:
                        found = np.bincount(np.concatenate(learned), minlength=1)
                        counts[: len(found)] += found
                        counts[0] += len(learned)
                held += sum(tokens)
                if len(numbers) >= block_entries or held >= BLOCK_TOKENS:
                    if not docs_only:
                        yield dictionary()
                    block += 1
                    held = 0
                    numbers = {END.encode(): 0}
                    counts = np.zeros(1 << 16, np.int64)
        if not docs_only:
            yield dictionary()

    return run


def _class_block(total: int, distinct: int, class_tokens: np.ndarray, class_words: np.ndarray, singles: int):
    """Documents of a block with their classes and the scores that need no hidden states."""
    unknown = total + distinct + 1

    def run(key: tuple, docs: pa.Table, entries: pa.Table) -> pa.Table:
        c, cls = np.zeros(entries.num_rows, np.int64), np.zeros(entries.num_rows, np.int64)
        number = entries.column("number").to_numpy()
        c[number], cls[number] = entries.column("c").to_numpy(), entries.column("cls").to_numpy()
        base = np.log10((c + 1) / unknown)
        inside = np.where(cls < singles, 0.0, np.log10((c + 1) / (class_tokens[cls] + class_words[cls] + 1)))
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "inside", "classes")}
        for codes in docs.column("codes").to_pylist():
            words = np.append(unplanes(codes).astype(np.int64), 0)
            out["n_tokens"].append(len(words))
            out["n_known"].append(int((c[words] > 0).sum()))
            out["base_score"].append(float(base[words].sum()))
            out["inside"].append(float(inside[words].sum()))
            out["classes"].append(np.ascontiguousarray(cls[words].astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes())
        return pa.table(
            {"doc_id": docs.column("doc_id").cast(pa.int64()), "train": docs.column("train"), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "inside": pa.array(out["inside"], pa.float64()), "classes": pa.array(out["classes"], pa.binary())}
        )

    return run


_CODED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, inside double, classes binary"


def read_classes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(2, -1).T).view("<u2").reshape(-1).astype(np.int64)


def forward_backward(docs: list[np.ndarray], model: Hmm, learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log10 likelihoods of sequences of classes and, to learn, expected counts of starts, moves and emissions.

    All sequences advance together, longest first, so that those still running are always the leading rows.
    """
    k, c = model.emit.shape
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    running = np.searchsorted(-size[order], -np.arange(longest), side="left")  # with more than t classes
    emit = np.ascontiguousarray(model.emit.T)
    ends = np.concatenate(([0], np.cumsum(size[order])))
    flat = np.concatenate([docs[i] for i in order]) if docs else np.empty(0, np.int64)
    likelihood = np.zeros(len(docs))
    alphas, scales, seen = [], [], []
    alpha = None
    for t in range(longest):
        now = flat[ends[: running[t]] + t]
        alpha = emit[now] * (model.start if t == 0 else alpha[: running[t]] @ model.move)
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        likelihood[: running[t]] += np.log10(scale)
        if learn:
            alphas.append(alpha)
            scales.append(scale)
            seen.append(now)
    out = np.zeros(len(docs))
    out[order] = likelihood
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    if learn and longest:
        beta = np.empty((0, k))
        gammas = [None] * longest
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                ahead = emit[seen[t + 1]] * beta / scales[t + 1][:, None]
                moves += alphas[t][: len(ahead)].T @ ahead
                beta = np.concatenate((ahead @ model.move.T, np.ones((running[t] - len(ahead), k))))
            else:
                beta = np.ones((running[t], k))
            gammas[t] = alphas[t] * beta
        moves *= model.move
        starts = gammas[0].sum(0)
        gamma, classes = np.concatenate(gammas), np.concatenate(seen)
        for i in range(k):
            emits[i] = np.bincount(classes, weights=gamma[:, i], minlength=c)
    return out, starts, moves, emits


def long_forward_backward(doc: np.ndarray, model: Hmm, learn: bool, piece: int | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one sequence, a piece at a time: what is kept of a piece is the state at its start."""
    k, c = model.emit.shape
    piece = piece or CHUNK_TOKENS
    emit = np.ascontiguousarray(model.emit.T)

    def forward(at: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        seen = emit[doc[at : at + piece]]
        alphas, scales = np.empty_like(seen), np.empty(len(seen))
        alpha = before
        for t in range(len(seen)):
            alpha = seen[t] * (model.start if alpha is None else alpha @ model.move)
            scales[t] = alpha.sum()
            alpha = alphas[t] = alpha / scales[t]
        return alphas, scales

    states: list[np.ndarray | None] = [None]
    likelihood = 0.0
    for at in range(0, len(doc), piece):
        alphas, scales = forward(at, states[-1])
        likelihood += float(np.log10(scales).sum())
        states.append(alphas[-1].copy())
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    if learn and len(doc):
        beta = None  # of the token after, with its emission and scale
        for i in range(len(states) - 2, -1, -1):
            at = i * piece
            now = doc[at : at + piece]
            alphas, scales = forward(at, states[i])
            gammas, aheads = np.empty_like(alphas), np.zeros_like(alphas)
            for t in range(len(now) - 1, -1, -1):
                if beta is not None:
                    aheads[t] = beta
                own = np.ones(k) if beta is None else model.move @ beta
                gammas[t] = alphas[t] * own
                beta = emit[now[t]] * own / scales[t]
            moves += alphas.T @ aheads
            for s in range(k):
                emits[s] += np.bincount(now, weights=gammas[:, s], minlength=c)
            starts = gammas[0]
        moves *= model.move
    return likelihood, starts, moves, emits


def _in_chunks(docs: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of documents of like length, so many tokens at a time; a document of more tokens is alone."""
    chunk, tokens = [], 0
    for i in np.argsort([len(d) for d in docs], kind="stable"):
        if chunk and len(docs[i]) > CHUNK_TOKENS:
            yield chunk
            chunk, tokens = [], 0
        chunk.append(int(i))
        tokens += len(docs[i])
        if tokens >= CHUNK_TOKENS:
            yield chunk
            chunk, tokens = [], 0
    if chunk:
        yield chunk


def _expected_counts(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.start.size + model.move.size + model.emit.size)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                docs = [read_classes(b) for b in batch.column(0).slice(at, 2000).to_pylist()]
                for chunk in _in_chunks(docs):
                    one = docs[chunk[0]]
                    _, s, m, e = long_forward_backward(one, model, True) if len(one) > CHUNK_TOKENS else forward_backward([docs[i] for i in chunk], model, True)
                    total += np.concatenate((s, m.ravel(), e.ravel()))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "value"])

    return run


def _score(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                docs = [read_classes(b) for b in batch.column("classes").to_pylist()]
                score = np.array(batch.column("inside").to_pylist(), float)
                for chunk in _in_chunks(docs):
                    one = docs[chunk[0]]
                    score[chunk] += long_forward_backward(one, model, False)[0] if len(one) > CHUNK_TOKENS else forward_backward([docs[i] for i in chunk], model, False)[0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "train", "n_tokens", "n_known", "base_score")), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's classes, each once, and how often it holds them: at most a number for each class, however long the text."""
    for batch in batches:
        found = [np.unique(read_classes(b), return_counts=True) for b in batch.column("classes").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([c.tolist() for c, _ in found], pa.list_(pa.int32())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))], names=["cls", "times"])


def starting_model(docs: list[tuple[np.ndarray, np.ndarray]], classes: int, states: int = STATES, rounds: int = 8, seed: int = 1) -> Hmm:
    """States from a spherical k-means over a few documents' class frequencies, which tend to stay as they are."""
    rng = np.random.default_rng(seed)
    emit = np.full((states, classes), 1.0 / classes)
    share = np.full(states, 1.0 / states)
    docs = [(c, n) for c, n in docs if n.sum() > 1]
    if len(docs) >= states:
        counts = np.zeros((len(docs), classes), np.float32)
        for i, (c, n) in enumerate(docs):
            counts[i, c] = n
        x = np.sqrt(counts)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = unit[rng.integers(len(docs))][None]
        while len(centre) < states:  # the documents least like the centres so far
            far = 1 - (unit @ centre.T).max(1)
            centre = np.concatenate((centre, unit[int((far * rng.random(len(far)) ** 0.1).argmax())][None]))
        for _ in range(rounds):
            near = (unit @ centre.T).argmax(1)
            for s in range(states):
                if (near == s).any():
                    centre[s] = unit[near == s].mean(0)
                    centre[s] /= np.linalg.norm(centre[s])
        for s in range(states):
            n = counts[near == s].sum(0, dtype=float)
            emit[s] = (n + 0.1) / (n.sum() + 0.1 * classes)
            share[s] = (near == s).mean() + 0.01
    move = np.full((states, states), 0.03 / max(1, states - 1))
    np.fill_diagonal(move, 0.97)
    return Hmm(share / share.sum(), move / move.sum(1, keepdims=True), emit)


def baum_welch_pass(coded: DataFrame, model: Hmm) -> Hmm:
    """One pass over all training sequences: expected counts summed across partitions, then normalised."""
    k, c = model.emit.shape
    found = coded.where("train").select("classes").mapInArrow(_expected_counts(model), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(k + k * k + k * c)
    total[found["cell"]] = found["value"]
    start, move, emit = total[:k] + SMOOTHING, total[k : k + k * k].reshape(k, k) + SMOOTHING, total[k + k * k :].reshape(k, c) + SMOOTHING
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def hmm_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, states: int = STATES, top_words: int = TOP_WORDS, suffix_classes: int = SUFFIX_CLASSES, passes: int = PASSES, start_docs: int = START_DOCS, block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df, a table scan or stored rows."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col, 7)).alias("train"))
    numbered = docs.mapInArrow(_blocks(True, block_entries), "block long, doc_id long, train boolean, codes binary")
    entries = docs.mapInArrow(_blocks(False, block_entries), "block long, number int, word string, c long")
    same = Window.partitionBy("word")
    counted = stored(entries.select("block", "number", "word", F.sum("c").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first")), "hmm-counts")

    vocabulary = counted.where("first and c > 0")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # words by the eighth of a power of two that their count lies in, so that the sort sees the most frequent ones only
    step = F.floor(8 * F.log2("c"))
    level, above = 0, 0
    for r in vocabulary.where(F.col("word") != END).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():
        level, above = r["step"], above + r["n"]
        if above >= top_words:
            break
    single = vocabulary.where(F.col("word") != END).where(step >= level).orderBy(F.col("c").desc(), "word").limit(top_words).select("word").collect()
    ranks = df.sparkSession.createDataFrame([(END, 0), *((r["word"], i + 1) for i, r in enumerate(single))], "tw string, rank int")
    singles = len(single) + 1
    # at most top_words rows
    classed = counted.join(F.broadcast(ranks), counted.word == ranks.tw, "left").withColumn("cls", F.coalesce("rank", F.lit(singles) + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(suffix_classes)).cast("int")))
    classes = singles + suffix_classes
    class_tokens, class_words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in classed.where("first and c > 0").groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_tokens[r["cls"]], class_words[r["cls"]] = r["c"], r["n"]

    back = classed.select(F.col("block").alias("eblock"), "number", "c", "cls")
    coded = stored(numbered.groupBy("block").cogroup(back.groupBy("eblock")).applyInArrow(_class_block(int(total), int(distinct), class_tokens, class_words, singles), _CODED), "hmm-coded")
    # The same documents in the same order however the rows are dealt. A limit after a sort sends that many rows of every task,
    # so a share of the rows, four times what is wanted, is taken first.
    share = min(1.0, 4 * start_docs / max(1, int(class_tokens[0])))  # every training text has one end
    mark = F.xxhash64("doc_id", "classes", F.lit(5))
    some = coded.where("train").where(F.pmod(mark, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).orderBy(mark, "doc_id", "classes").limit(start_docs)
    some = some.select("classes").mapInArrow(_frequencies, "cls array<int>, times array<long>").collect()
    model = starting_model([(np.array(r["cls"], np.int64), np.array(r["times"], np.int64)) for r in some], classes, states)
    for _ in range(passes):
        model = baum_welch_pass(coded, model)
    scored = coded.mapInArrow(_score(model), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
