"""Vectorised words and word-window hashes over the byte buffers of Arrow string columns.

A task works through its Arrow batches in blocks of about `BLOCK` bytes, cut at separators, so memory follows the
block and the number of words, not the batch. Hashes have 64 bits; `words_of` gives them per word, `windows` per
run of consecutive words of one text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, one batch held at a time, with its memory released after every batch that it takes and at the end."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(taken(batches))
        release()

    return out


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`run`, with memory released after every large group."""

    def out(table: pa.Table) -> pa.Table:
        large = table.nbytes > 4 * BLOCK
        result = run(table)
        del table
        if large:
            release()
        return result

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)[:n]


class Alphabet:
    """Which bytes separate words, and whether A-Z count as a-z."""

    def __init__(self, separators: bytes, lower: bool) -> None:
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
            self.inside[65:91] = True
        self.code = _LETTERS[fold]


@dataclass
class Words:
    """Words of a run of texts: `first[i]:first[i + 1]` are those of text i; begin and end are byte offsets."""

    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, at: np.ndarray, alphabet: Alphabet) -> Words:
    """Words of the texts at[0]:at[1], at[1]:at[2], ... of the bytes `data`."""
    lo, hi = int(at[0]), int(at[-1])
    starts = np.zeros(0, np.int64)
    hashes, begins, ends = [np.zeros(0, np.uint64)], [starts], [starts]
    while lo < hi:
        cut = min(hi, lo + BLOCK)
        if cut < hi:
            k = int(np.searchsorted(at, cut, "right")) - 1
            if at[k] > lo:
                cut = int(at[k])
            else:
                while cut < hi and alphabet.inside[data[cut]] and cut < at[k + 1]:
                    step = alphabet.inside[data[cut : min(cut + 4096, int(at[k + 1]))]]
                    gap = np.flatnonzero(~step)
                    cut += int(gap[0]) if len(gap) else len(step)
        block = data[lo:cut]
        inside = alphabet.inside[block]
        edge = np.zeros(len(block) + 1, bool)
        own = at[(at > lo) & (at < cut)] - lo
        edge[0] = edge[-1] = True
        edge[own] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        b = np.flatnonzero(after & (~before | edge))
        e = np.flatnonzero(before & (~after | edge))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(alphabet.code[block] * powers(_BASE, len(block)), out=sums[1:])
        hashes.append(mix((sums[e] - sums[b]) * powers(_BASE_INV, len(block) + 1)[b]))
        begins.append(b + lo)
        ends.append(e + lo)
        lo = cut
    begin = np.concatenate(begins)
    return Words(np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, at))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether the window lies within one text."""
    count = len(words.hash)
    if count < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(words.hash * powers(_STEP, count), out=sums[1:])
    m = count - n + 1
    value = mix((sums[n:] - sums[:m]) * powers(_STEP_INV, m) + np.uint64(n))
    text = words.text
    return value, text[n - 1 :] == text[:m]


def sets_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word windows of each text, sorted, and where each text's begin; a shorter text is one window."""
    value, whole = windows(words, n)
    text = words.text[: len(value)][whole]
    value = value[whole]
    length = np.diff(words.first)
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = length[short] > k
            extra[has] = mix(extra[has] + words.hash[words.first[short[has]] + k])
        text, value = np.concatenate((text, short)), np.concatenate((value, extra))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    text, value = text[keep], value[keep]
    return value, np.searchsorted(text, np.arange(len(words.first)))
