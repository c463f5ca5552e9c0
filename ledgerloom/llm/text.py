"""Words of a text in Python workers; the same words as functions.scalars.words gives in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Letters and digits of any script; tests compare it with [\p{L}\p{N}].
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():  # lower-casing first can't change what a word is
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


class WordSets:
    """Distinct words of each text as numbers, with one 64-bit hash for each word of the batch."""

    def __init__(self, texts: list[str | None]):
        sets = [set(words(t)) for t in texts]
        self.rows = np.array([i for i, s in enumerate(sets) if s], np.int64)
        sets = [s for s in sets if s]
        index: dict[str, int] = {}
        self.flat = np.fromiter((index.setdefault(w, len(index)) for s in sets for w in s), np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))

    def set_hashes(self) -> np.ndarray:
        """A signed 64-bit hash of each set: the sum of its words' mixed hashes."""
        if not len(self.sizes):
            return np.zeros(0, np.int64)
        return np.add.reduceat(mix(self.hashes + np.uint64(0x51ED270B))[self.flat], self.starts).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text each, so that the length of texts can't fill a worker's memory."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
