"""Words and shingles of whole texts as numpy arrays.

A column of texts is cut into chunks of whole documents. Words are found in the
UTF-8 bytes by table look-up, and every word gets a 64-bit hash (a polynomial
over random byte codes, then mixed), so a chunk of documents costs a few numpy
passes whatever its number of words. A null text counts as empty.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
#: The step of a second hash, independent of the first.
SECOND = 0x9FB21C651E98DF25


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit; works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more."""
    size = 1 << max(12, int(n).bit_length())
    if size > 1 << 22:  # a single very long text: do not keep its tables
        return _powers.__wrapped__(base, size)
    return _powers(base, size)


class Alphabet:
    """Which bytes belong to words, and a random code for each byte."""

    def __init__(self, separators: bytes, lower: bool):
        self.keep = np.ones(256, bool)
        self.keep[list(separators)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.code = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[self.fold]


_SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words [^\x20\x09-\x0D]+ as they stand, the same with A-Z lower-cased, and lower-cased runs of ASCII letters, digits and non-ASCII.
PLAIN = Alphabet(_SPACES, lower=False)
LOWER = Alphabet(_SPACES, lower=True)
ALNUM = Alphabet(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), lower=True)


@dataclass
class Chunk:
    """Words of the documents [row, row + len(first) - 1) of a batch; document d has the words [first[d], first[d + 1])."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    words: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def last(self) -> np.ndarray:
        """For each word, the end of its document's words."""
        return np.repeat(self.first[1:], np.diff(self.first))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    up, down = powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    codes = alphabet.code[data]
    codes *= up[: len(data)]
    np.cumsum(codes, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a space after each, and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    padded = pc.binary_join_element_wise(pc.fill_null(pc.cast(column, pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if isinstance(padded, pa.ChunkedArray):
        padded = padded.combine_chunks()
    _, offsets, data = padded.buffers()
    offsets = np.frombuffer(offsets, np.int64)[padded.offset : padded.offset + len(padded) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, alphabet: Alphabet, size: int = CHUNK) -> Iterator[Chunk]:
    if not len(column):
        return
    data, offsets = buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        keep = alphabet.keep[part]
        edge = np.flatnonzero(keep[1:] != keep[:-1]) + 1
        if keep[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        first = np.searchsorted(starts, offsets[row : stop + 1] - offsets[row])
        yield Chunk(row, part, starts, ends, first, word_hashes(part, starts, ends, alphabet))
        row = stop


def one(text: str, alphabet: Alphabet) -> np.ndarray:
    """Word hashes of one text."""
    return next(chunks(pa.array([text]), alphabet)).words


def grams(words: np.ndarray, k: int, step: int = _STEP) -> np.ndarray:
    """Hash of each k consecutive words, across documents too: len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += words[j : j + n] * np.uint64(pow(step, j, 1 << 64))
    else:
        up, down = powers(step, len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        out = (sums[k:] - sums[:n]) * down[:n]
    return mix(out + np.uint64(k))


def inside(chunk: Chunk, k: int) -> np.ndarray:
    """Which of grams(words, k) lie in one document."""
    n = len(chunk.words) - k + 1
    return np.arange(k, k + n) <= chunk.last()[:n] if n > 0 else np.zeros(0, bool)


def shingle_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each document; with fewer words the whole sequence is one; without words none."""
    g = grams(chunk.words, k)
    for a, b in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield grams(chunk.words[a:b], b - a) if b > a else g[:0]
