"""Vectorised byte work on batches of texts, for use inside Arrow tasks.

Texts are joined with newlines into buffers of about CHUNK bytes, so that numpy handles many short texts at
once and memory stays bounded by the longest text. Hashes are 64 bits: byte values drawn at random, times
powers of an odd number, summed modulo 2**64; the hash of any substring comes from two running sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def give_back() -> None:
    """Return what was freed to the system: workers live on between tasks, and allocators keep their largest size otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A well mixing bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Texts first .. first + n of a batch, joined; text i lies in data[begin[i]:end[i]]."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def sums(self) -> np.ndarray:
        up, _ = _powers(len(self.data))
        out = np.empty(len(self.data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(_byte_values()[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[begin:end]; equal for equal bytes wherever they stand."""
        _, down = _powers(len(self.data) + 1)
        return mix64((sums[end] - sums[begin]) * down[begin])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of each word."""
        solid = np.empty(len(self.data) + 2, np.int8)
        solid[0] = solid[-1] = 0
        solid[1:-1] = ~_SPACES[self.data]
        edge = np.diff(solid)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return begin, end, np.searchsorted(self.begin, begin, "right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return run[self.end] - run[self.begin]


def chunks(texts: Iterable[bytes], limit: int = CHUNK) -> Iterator[Chunk]:
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield _chunk(first, held)
            held, size, first = [], 0, i
        held.append(t)
        size += len(t) + 1
    if held:
        yield _chunk(first, held)


def _chunk(first: int, held: list[bytes]) -> Chunk:
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    end = np.cumsum(sizes + 1) - 1
    return Chunk(first, np.frombuffer(b"\n".join(held) + b"\n", np.uint8), end - sizes, end)


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8, null as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def windows(word_hash: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within a text, and the first word's index of each."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(text[: n] == text[k - 1 :])
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xA24BAED4963EE407) + word_hash[first + j]
    return mix64(out), first


def _fold(solid: str) -> np.ndarray:
    """For each byte the byte it counts as in a term, 0 if it ends one: ASCII only where named, A-Z lower-cased, all of other characters."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in solid.encode():
        out[c] = c
        out[ord(chr(c).upper())] = c
    return out


LETTERS = _fold("abcdefghijklmnopqrstuvwxyz")
LETTERS_DIGITS = _fold("abcdefghijklmnopqrstuvwxyz0123456789")


def terms_of(texts: list[bytes], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each term's text number and its place among the distinct terms, and these."""
    data = fold[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    solid = data != 0
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    begin, end = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    raw = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return np.searchsorted(first, begin, "right") - 1, raw.indices.to_numpy().astype(np.int64), raw.dictionary.cast(pa.binary()).cast(pa.string())


def batches_by_bytes(batch: pa.RecordBatch, column: str, size: int = 8 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in the column have about so many bytes together, one row at least."""
    used = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(used, (used[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to
