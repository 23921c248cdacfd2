"""BPE encoding and decoding with a public tokenizer file, with tree concatenation for long unsplit text.

A text splits into pre-tokens, and each distinct one is encoded once for each task. A pre-token longer than run_limit is
cut into pieces that are encoded in parallel, as rows of their own. Neighbouring halves are then joined pairwise up a tree:
a window around the join, first of a few tokens, is encoded again and grows until its first token is the left half's and
its last token is the right half's. A sequence is the BPE encoding of its text when each pair of neighbouring tokens is
that of theirs, so the two halves outside the window then stand as they are.

Texts of characters for which the library's normaliser and splitter are plain (ASCII and Latin-1 letters) take a quick
path; all others go through the library's own normaliser and splitter.

Defined cases: null text is empty and has no ids; rows with equal or null ids stay apart; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES

TOKENIZER = "word_bpe_49k.json"
#: Characters of a pre-token beyond which it is encoded in pieces of this size.
RUN_LIMIT = 4096
#: Documents that a worker holds at a time.
SLICE = 500
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7e\xc0-\xff]")
#: The splitter of the tokenizer file, for lower-cased plain text.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """A tokenizer file with the ids of the words and pre-tokens met so far."""

    def __init__(self, name: str, run_limit: int = RUN_LIMIT):
        from tokenizers import Tokenizer

        spec = open(tokenizer_path(name), encoding="utf-8").read()
        self.tok = Tokenizer.from_str(spec)
        self.closed = self.tok.model
        self._spec = spec
        self._open = None
        self.run_limit = run_limit
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = added
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.bytes_to_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.chars_to_bytes = {ord(c): b for b, c in self.bytes_to_chars.items()}

    @property
    def open(self):
        """The same merges without the mark for the end of a word, for pieces that go on."""
        if self._open is None:
            from tokenizers import Tokenizer

            spec = json.loads(self._spec)
            spec["model"]["end_of_word_suffix"] = None
            self._open_tok = Tokenizer.from_str(json.dumps(spec))
            self._open = self._open_tok.model
        return self._open

    def mapped(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes_to_chars)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Ids of a normalised pre-token."""
        got = self.pieces.get(piece)
        if got is None:
            got = tuple(t.id for t in self.closed.tokenize(self.mapped(piece)))
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def spans(self, text: str, ids: list[int]) -> list[str]:
        """What each of the tokens covers of the text (as mapped characters)."""
        out, at = [], 0
        for i in ids:
            n = len(self.tok.id_to_token(i).removesuffix("</w>"))
            out.append(text[at : at + n])
            at += n
        return out

    def is_plain(self, text: str) -> bool:
        return (text.isascii() and not re.search("[\x1c-\x1f\x7f]", text)) or not _PLAIN.search(text)

    def pretokens(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without special tokens, in order."""
        if self.is_plain(text):
            return _SPLIT.findall(text.lower())
        split = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return [bytes(p.translate(self.chars_to_bytes).encode("latin-1")).decode("utf-8", "surrogateescape") for p, _ in split]

    def segments(self, text: str) -> list[str]:
        """The text cut at the special tokens in it, which stand between the other parts."""
        return self.split_special.split(text) if self.split_special and "<|" in text else [text]

    def ids(self, text: str) -> np.ndarray:
        out: list[int] = []
        for part in self.segments(text):
            if part in self.special:
                out.append(self.special[part])
            elif self.is_plain(part):
                words = self.words
                for w in part.split():
                    got = words.get(w)
                    if got is None:
                        got = tuple(i for p in _SPLIT.findall(w.lower()) for i in self.piece_ids(p))
                        if len(words) >= CACHE_ENTRIES:
                            words.clear()
                        words[w] = got
                    out += got
            else:
                for p in self.pretokens(part):
                    out += self.piece_ids(p)
        return np.array(out, np.int32)


def join_halves(left: tuple[str, list[int], list[str]], right: tuple[str, list[int], list[str]], closed: bool, bpe: WordBpe, window: int = 4) -> tuple[str, list[int], list[str]]:
    """(text, ids, token strings) of two neighbouring pieces; closed: the right one ends its pre-token."""
    (lt, li, ls), (rt, ri, rs) = left, right
    while True:
        a, b = min(window, len(li)), min(window, len(ri))
        whole_left, whole_right = a == len(li), b == len(ri)
        end = closed and whole_right
        cut_l, cut_r = sum(map(len, ls[len(ls) - a :])), sum(map(len, rs[:b]))
        text = lt[len(lt) - cut_l :] + (rt if whole_right else rt[:cut_r])
        again = (bpe.closed if end else bpe.open).tokenize(text)
        ids = [t.id for t in again]
        if (whole_left or (ids and ids[0] == li[len(li) - a])) and (whole_right or (ids and ids[-1] == ri[b - 1])):
            return lt + rt, li[: len(li) - a] + ids + ri[b:], ls[: len(ls) - a] + bpe.spans(text, ids) + rs[b:]
        window *= 2


def tree_concat(pieces: list[tuple[str, list[int], list[str]]], bpe: WordBpe) -> list[int]:
    """Ids of a pre-token from its encoded pieces, by joining neighbours up a tree."""
    while len(pieces) > 1:
        paired = [join_halves(pieces[i], pieces[i + 1], i + 2 == len(pieces), bpe) for i in range(0, len(pieces) - 1, 2)]
        pieces = paired + pieces[len(paired) * 2 :]
    return pieces[0][1]


def encode_piece(text: str, closed: bool, bpe: WordBpe) -> tuple[list[int], list[str]]:
    tokens = (bpe.closed if closed else bpe.open).tokenize(text)
    ids = [t.id for t in tokens]
    return ids, bpe.spans(text, ids)


def _encode_short(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(name)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = [bpe.ids(t) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))], names=["doc_id", "ids"])

    return run


_PIECES = "rid long, doc_id long, seg int, part int, parts int, piece string, ids array<int>"


def _cut_long(name: str, run_limit: int):
    """Rows of a text with long pre-tokens, in order: ids of what lies between them, and their pieces, not encoded yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(name)
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("seg", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("piece", pa.string()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, short, seg = [], [], 0
                for part in bpe.segments(text):
                    if part in bpe.special:
                        short.append(bpe.special[part])
                        continue
                    for p in bpe.pretokens(part):
                        m = bpe.mapped(p)
                        if len(m) <= run_limit:
                            short += bpe.piece_ids(p)
                            continue
                        rows.append((rid, doc_id, seg, 0, 0, None, list(short)))
                        short.clear()
                        n = -(-len(m) // run_limit)
                        rows += [(rid, doc_id, seg + 1, j, n, m[j * run_limit : (j + 1) * run_limit], None) for j in range(n)]
                        seg += 2
                rows.append((rid, doc_id, seg, 0, 0, None, list(short)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return run


def _encode_pieces(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(name)
        for batch in batches:
            ids = []
            for part, parts, piece, old in zip(*(batch.column(c).to_pylist() for c in ("part", "parts", "piece", "ids")), strict=True):
                ids.append(old if piece is None else encode_piece(piece, part + 1 == parts, bpe)[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(ids, pa.list_(pa.int32()))], names=batch.schema.names)

    return run


def _assemble(name: str):
    """Join the pieces of one document; the group is one document's rows."""

    def run(group: pa.Table) -> pa.Table:
        bpe = WordBpe(name)
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("seg", "part", "parts", "piece", "ids")), strict=True), key=lambda r: r[:2])
        out: list[int] = []
        i = 0
        while i < len(rows):
            _, _, parts, piece, ids = rows[i]
            if piece is None:
                out += ids
                i += 1
                continue
            out += tree_concat([(r[3], r[4], bpe.spans(r[3], r[4])) for r in rows[i : i + parts]], bpe)
            i += parts
        return pa.table({"doc_id": group.column("doc_id").slice(0, 1).cast(pa.int64()), "ids": pa.array([out], pa.list_(pa.int32()))})

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = TOKENIZER, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(doc_id, ids array<int>) for each row, as the tokenizers library encodes the whole text without added tokens.

    df is a table scan or stored rows: its rows keep their places when they are read again.
    """
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # UTF-8 takes at most four bytes a character, so a shorter stretch cannot hold a pre-token beyond the limit.
    long_run = F.coalesce(F.length("text") > run_limit // 4, F.lit(False)) & F.coalesce(F.col("text").rlike(rf"\S{{{run_limit // 4}}}"), F.lit(False))
    marked = docs.withColumn("long_run", long_run)
    short = marked.where(~F.col("long_run")).select("doc_id", "text").mapInArrow(_encode_short(tokenizer), "doc_id long, ids array<int>")
    cut = marked.where("long_run").select("rid", "doc_id", "text").mapInArrow(_cut_long(tokenizer, run_limit), _PIECES)
    pieces = cut.repartition("rid", "seg", "part").mapInArrow(_encode_pieces(tokenizer), _PIECES)
    return short.union(pieces.groupBy("rid").applyInArrow(_assemble(tokenizer), "doc_id long, ids array<int>"))


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(name)
        size = bpe.tok.get_vocab_size()
        strings = [bpe.tok.id_to_token(i) or "" for i in range(size)]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = batch.column(1)
                flat, ends = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))))
                # of one document at a time: as Python numbers the ids take ten times their room
                texts = [" ".join(map(strings.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids, decoded) for rows of (doc_id, ids), as the library's decode(ids, skip_special_tokens=False).

    The tokenizer file names no decoder, for which the library joins the token strings by single spaces.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decode(tokenizer), "doc_id long, ids array<int>, decoded string")
