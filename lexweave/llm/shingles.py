"""Hashed word shingles of whole texts, computed over Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 18
# Texts are copied this many at a time, not with their whole batch.
SLICE_TEXTS = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _text_chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive texts, some ``CHUNK_BYTES`` at a time; null is empty."""
    for start in range(0, len(texts), SLICE_TEXTS):
        yield from _chunks_of_slice(texts.slice(start, SLICE_TEXTS))


def _chunks_of_slice(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        limit = offsets[start] + CHUNK_BYTES
        end = max(start + 1, int(np.searchsorted(offsets, limit, side="right")) - 1)
        end = min(end, len(texts))
        yield data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


class WordHasher:
    """Hashes of the lower-cased (A-Z) words of texts.

    A word's hash is a polynomial in its bytes, found from prefix sums over the whole
    chunk, so that no word is touched on its own.
    """

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, first word of each text and the end)."""
        n = len(data)
        self._grow(n + 1)
        lower = np.where((data >= 65) & (data <= 90), data + 32, data)
        word = (data != 32) & ((data < 9) | (data > 13))
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.concatenate(([False], word[:-1])) if n else word
        starts = np.flatnonzero(word & (~before | cut[:n]))
        after = np.concatenate((word[1:], [False])) if n else word
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (not cut at texts)."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + n] + np.uint64(i)
    return mix(out)


def shingle_sets(texts: pa.Array, size: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text.

    With fewer than ``size`` words the whole sequence is the one shingle; without words
    there is none.
    """
    for data, offsets in _text_chunks(texts):
        words, firsts = hasher.words(data, offsets)
        shingles = shingle_hashes(words, size)
        for start, end in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if end - start >= size:
                found = np.sort(shingles[start : end - size + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif end > start:
                few = shingle_hashes(words[start:end], end - start)
                yield mix(few + np.uint64(end - start))
            else:
                yield np.zeros(0, np.uint64)
