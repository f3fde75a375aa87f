"""Cuts a batch of texts into pieces at white space, and tells equal pieces apart once a batch.

The pieces lie in the batch's own buffer; Arrow's dictionary encoding finds the distinct ones, so
that work done for a piece (merges, counts, lookups) is done once for each distinct piece."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Pieces(NamedTuple):
    distinct: list[bytes]
    codes: np.ndarray  # of each piece, its place in distinct
    docs: np.ndarray  # of each document, its first piece; one more at the end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # letters 1, digits 2, other visible ASCII 3, the rest 0
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _encode(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> Pieces:
    offsets = np.append(starts, len(data)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return Pieces(array.dictionary.to_numpy(zero_copy_only=False).tolist(), array.indices.to_numpy(zero_copy_only=False), docs)


def words(texts: pa.Array) -> Pieces:
    """Runs of bytes other than white space (space, 9 to 13), A-Z as a-z."""
    data, at = _buffer(texts)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    rank = np.cumsum(solid, dtype=np.int32)[starts] - 1
    return _encode(_LOWER[data[solid]], rank, np.searchsorted(starts, at))


def chunks(texts: pa.Array, lower: bool = False, bare: bool = False) -> Pieces:
    """Pieces between which no match of the usual pre-tokenising patterns (runs of letters, digits,
    signs or white space, a space going with what follows) can reach.

    A piece begins at a white-space byte after a character that surely is none, after a lone line
    feed, tab or the like between such characters, and where letters, digits and signs of ASCII or
    Latin-1 meet (but for a letter after an apostrophe). Where it can't be told cheaply, the piece goes on.
    lower: A-Z as a-z. bare: without the white-space byte that a piece begins with, which may leave it empty."""
    data, at = _buffer(texts)
    n = len(data)
    if not n:
        return Pieces([], np.zeros(0, np.int32), np.zeros(len(at), np.int64))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    unsure = space | (data < 33) | (data == 127)
    high, kind = data >= 128, _KIND[data]
    if high.any():  # white space beyond ASCII ends in one of these ways
        lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
        near = np.zeros(n, bool)
        near[1:] |= data[:-1] == 0xC2
        near[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        unsure |= high & (near | lead)
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = 1
    begin = np.zeros(n, bool)
    begin[1:] = space[1:] & ~unsure[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    lone = begin & (data != 32)
    begin[1:] |= lone[:-1] & ~unsure[1:]
    a, b = kind[:-1], kind[1:]
    begin[1:] |= (a != b) & (a > 0) & (b > 0) & ((data[:-1] != 39) | (b != 1))
    begin[begins] = True
    # what follows a text's first byte was judged by the text before it only if it began a lone piece, which stays exact
    starts = np.flatnonzero(begin)
    docs = np.searchsorted(starts, at)
    if bare:
        gone = space[starts]
        keep = np.ones(n, bool)
        keep[starts[gone]] = False
        starts = starts - (np.cumsum(gone) - gone)
        data = data[keep]
    return _encode(_LOWER[data] if lower else data, starts, docs)


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the pieces one after the other (flat: those of the distinct pieces), and where each piece's begin."""
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    each = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(each)))
    places = np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], each)
    return flat[places], ends


class Memory(dict):
    """A cache of two generations: bounded by entries and bytes, and what is in use stays."""

    def __init__(self, make, limit: int = 200_000, room: int = 24 << 20):
        super().__init__()
        self.make, self.limit, self.room, self.held, self.old = make, limit, room, 0, {}

    def _turn(self) -> None:
        if len(self) >= self.limit or self.held >= self.room:
            self.old, self.held = dict(self), 0
            self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self._turn()
        self[key] = value
        self.held += len(key) + len(value)
        return value

    def many(self, keys: list, make) -> list:
        """Values of the keys; make gets the new ones, some at a time."""
        values = [self.get(k) if k in self else self.old.get(k) for k in keys]
        missing = [i for i, v in enumerate(values) if v is None]
        for at in range(0, len(missing), 8192):
            some = missing[at : at + 8192]
            for i, v in zip(some, make([keys[i] for i in some])):
                values[i] = v
        self._turn()
        before = len(self)
        self.update(zip(keys, values))
        if len(self) > before:
            self.held += sum(len(k) + len(v) for k, v in zip(keys, values)) * (len(self) - before) // len(keys)
        return values
