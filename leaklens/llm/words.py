"""Vectorised word hashing over Arrow string columns (used inside tasks).

A word is a maximal run of ASCII letters, digits and bytes above 0x7F, so
every script's letters count as word bytes.  Nothing is decoded row by row:
the Arrow data buffer is read as one byte array.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


class Words(NamedTuple):
    hash: np.ndarray    # uint64 per word
    ptr: np.ndarray     # int64, word range of document i is ptr[i]:ptr[i+1]
    start: np.ndarray   # byte offset of a word in its buffer
    end: np.ndarray
    base: np.ndarray    # byte offset of each document in that buffer, and the end
    data: np.ndarray    # the bytes


@contextmanager
def without_cycles() -> Iterator[None]:
    """No cycle collection within: for work that forms no cycles but keeps very
    many words, which every pass would walk.  Later tasks of the worker have it again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(lo):ord(hi) + 1] = True
    table[128:] = True
    return table


def _byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string array without nulls."""
    if texts.type == pa.large_string():
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    base = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[base[0]:base[-1]]
    return raw, base - base[0]


def split(texts: pa.Array, lower: bool = True) -> Words:
    """Word hashes of each text; a null text has no words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    raw, base = _byte_view(texts)
    is_word = np.zeros(len(raw) + 2, dtype=bool)
    is_word[1:-1] = _word_bytes()[raw]
    first = np.zeros(len(raw) + 2, dtype=bool)
    first[base + 1] = True          # a document starts here (or the buffer ends)
    start = np.flatnonzero(is_word[1:-1] & (~is_word[:-2] | first[1:-1]))
    end = np.flatnonzero(is_word[1:-1] & (~is_word[2:] | first[2:])) + 1
    return Words(_hash(raw, start, end), np.searchsorted(start, base), start, end, base, raw)


def _hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    mask = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)
    out = mix((lanes[start] & mask[np.minimum(length, 8)]) + length.astype(U64) * U64(0x9E3779B97F4A7C15))
    left, at = np.flatnonzero(length > 8), 8
    while len(left):
        lane = lanes[start[left] + at] & mask[np.minimum(length[left] - at, 8)]
        out[left] = mix(out[left] * U64(0x9E3779B97F4A7C15) + lane)
        at += 8
        left = left[length[left] > at]
    return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, ptr) of the word n-grams of each document.

    A document of fewer than n words (but at least one) has one shingle of
    all its words.
    """
    h, ptr = words.hash, words.ptr
    count = np.diff(ptr)
    out_n = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_ptr = np.concatenate([[0], np.cumsum(out_n)])
    total = len(h)
    if total == 0:
        return np.zeros(0, U64), out_ptr
    padded = np.concatenate([h, np.zeros(n, U64)])
    doc = np.repeat(np.arange(len(count)), count)
    left = ptr[1:][doc] - np.arange(total)      # words from here to the document's end
    acc = np.zeros(total, U64)
    for i in range(n):
        acc = acc * U64(0xD6E8FEB86659FD93) + np.where(i < left, padded[i:i + total], U64(0))
    whole = (left >= n) | ((np.arange(total) == ptr[:-1][doc]) & (count[doc] < n))
    return mix(acc[whole]), out_ptr


def occurrences(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Tag each value by how often it came before in its document, so that
    multisets can be compared as sets."""
    if not len(values):
        return values
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(v))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    tagged = v.copy()
    again = rank > 0
    tagged[again] = mix(v[again] + rank[again].astype(U64) * U64(0xA0761D6478BD642F))
    out = np.empty_like(values)
    out[order] = tagged
    return out


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``max_bytes`` of text each (a longer text
    is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
