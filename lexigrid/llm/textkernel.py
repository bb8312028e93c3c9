"""Vectorised text kernels over Arrow string columns.

A word is a maximal run of letters and digits of the lower-cased text. Words are hashed by prefix sums of
polynomial terms, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
NOT_WORD = r"[^\p{L}\p{N}]+"
CHUNK = 1 << 18

# workers live on between tasks: freed batches and large arrays go back to the system
pa.set_memory_pool(pa.system_memory_pool())
if sys.platform == "linux":
    _libc = ctypes.CDLL(None)
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: fixed, else it grows with what is freed
        _libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * CHUNK)
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches, column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with about ``most`` bytes of text each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            limit = (ends[at - 1] if at else 0) + most
            to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets (rows + 1); null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the rows of a string column: hash, and the row bounds within the list of words."""

    def __init__(self, column: pa.Array, keep_text: bool = False):
        text = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), NOT_WORD, " ")
        data, offsets = raw(text)
        n = len(data)
        inside = data != 32
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        first = first[:n]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (first | ~before))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:] & ~first[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        up, down = powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(len(column)), self.counts)
        self.data = data if keep_text else None

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of each run of n words within a row."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = total - n + 1
        out = np.zeros(size, np.uint64)
        for i in range(n):
            out = out * np.uint64(BASE) + self.hashes[i : i + size]
        rows = self.rows[:size]
        whole = rows == self.rows[n - 1 :]
        return mix(out[whole], n), rows[whole]


def words_of(text: str | None) -> list[str]:
    """The same words, for brute force and small inputs."""
    return pc.replace_substring_regex(pc.utf8_lower(pa.array([text or ""])), NOT_WORD, " ")[0].as_py().split()


def unique_in_rows(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and the row bounds."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.searchsorted(rows[keep], np.arange(n_rows + 1))
