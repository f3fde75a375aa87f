"""Byte-level BPE, encoded and decoded exactly as merging by rank would.

Bytes are mapped to Latin-1 characters so that pyahocorasick finds every vocabulary entry in a
pre-token. The encoder walks from longest matches and steps back where a token can't stand beside
the one before it. Two tokens can stand side by side if merging their joined bytes gives just
these two; that answer is remembered. A sequence in which all neighbours are compatible is the one
that merging yields, and each position is given up at most once, so time is linear.

Null texts are empty: no ids. Texts of any length, ties and repeated rows need no special care:
each row is encoded by itself. No rows give no rows. Other columns of the input are not read."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_arrow, text_array, text_batches
from .pieces import Memory, chunks, gather


class Codec:
    """Encoder and decoder for a file of ranks (base64 token, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.beside: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) == 1 or self.merge(token) == [rank]:  # others never come out of merging
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.shorter = [-1] * len(self.tokens)  # the longest entry that begins each one
        for text, (rank, size) in self.automaton.items():
            for k in range(size - 1, 0, -1):
                if (found := self.automaton.get(text[:k], None)) is not None:
                    self.shorter[rank] = found[0]
                    break
        self.automaton.make_automaton()
        self.memory = Memory(self._chunk)

    def merge(self, piece: bytes) -> list[int]:
        """Ids by merging the neighbours of lowest rank, again and again; for short pieces."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        tokens, compatible, text = self.tokens, self.compatible, piece.decode("latin-1")
        path = [rank for _, (rank, _) in self.automaton.iter_long(text)]
        if all(map(compatible, path, path[1:])):  # longest matches all the way
            return path
        n, longest, shorter = len(piece), self.automaton.iter_long, self.shorter
        dead = bytearray(n + 1)
        path, at = [], 0
        token = next(longest(text))[1][0]
        while at < n:
            while token >= 0 and (dead[at + len(tokens[token])] or path and not compatible(path[-1], token)):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += len(tokens[token])
                if at < n:
                    token = next(longest(text, at))[1][0]
            else:  # nothing can stand here after that token: it goes, for its next shorter prefix
                dead[at] = 1
                token = path.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return path

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha() or chunk[:1] == b" " and chunk[1:].isalpha():  # of ASCII letters: one pre-token
            return array("I", self.encode_piece(chunk)).tobytes()
        ids: list[int] = []
        for token in self.find(chunk.decode()):
            ids += self.encode_piece(token.encode())
        return array("I", ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        cut = chunks(texts)
        if not cut.distinct:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        held = [self.memory[x] for x in cut.distinct]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, ends = gather(np.frombuffer(b"".join(held), "<u4"), sizes, cut.codes)
        return ids, ends[cut.docs]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int> of each row's whole text."""
    bounded_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_batches(batches, "text"):
            ids, at = own.encode(text_array(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the bytes that the ids stand for; null ids give none."""
    bounded_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; digests of the ids and of the decoded bytes instead of both columns."""
    bounded_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_batches(batches, "text"):
            ids, at = own.encode(text_array(batch.column("text")))
            each = [ids[a:b] for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in each], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
