"""Vectorised word and shingle hashing over batches of UTF-8 texts.

A word is a maximal run of bytes outside x20 and x09-x0D. Hashes are 64 bits wide, depend on the bytes of
the word only, and are the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text, and rows, handled at once.
CHUNK, ROWS = 1_500_000, 8192


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit weight for each byte value.
_WEIGHT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, step, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of some texts laid end to end.

    buf: bytes, each text followed by a newline; start, end: of each word in buf; doc: of each word;
    first: index of each text's first word, and at the end the number of words.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.n_docs = len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.zeros(len(self.buf) + 1, dtype=np.int8)
        inside[1:] = ~SPACE[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]  # every text ends with a newline, so the edges pair up
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        out, at, n = np.empty(len(self.start), dtype=np.uint64), 0, len(self.start)
        while at < n:  # in stretches of about CHUNK bytes, to bound memory on very long texts
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK, side="right")))
            base, stop = self.start[at], self.end[to - 1]
            start, end = self.start[at:to] - base, self.end[at:to] - base
            up, down = _powers(stop - base + 1)
            total = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum(_WEIGHT[self.buf[base:stop]] * up[: stop - base], out=total[1:])
            out[at:to] = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
            at = to
        return out


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of width words within a document, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    keep = words.doc[:n] == words.doc[width - 1 :]
    return mix(out[keep]), words.doc[:n][keep]


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, all else as it is."""
    return text.lower()


def release() -> None:
    """Hands memory that is free back to the system: a Python worker lives on after its task, and what it keeps counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most about CHUNK bytes of text and ROWS rows, at least a row each; a null text is empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        at, size = 0, 0
        lengths = [0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()]
        for k, n in enumerate(lengths):
            if k > at and (size + n > CHUNK or k - at >= ROWS):
                yield batch.slice(at, k - at), [x or b"" for x in texts.slice(at, k - at).to_pylist()]
                at, size = k, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at), [x or b"" for x in texts.slice(at).to_pylist()]
    release()
