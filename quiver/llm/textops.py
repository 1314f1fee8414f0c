"""Vectorised text helpers shared by the llm operators; everything here runs inside Spark tasks.

``word_table`` splits a whole Arrow batch of texts into words ``[^\\x20\\x09-\\x0D]+`` of the
A-Z-lower-cased UTF-8 bytes and hashes each word to 64 bits, with numpy and no per-word Python.
A null text counts as the empty text. Long batches are cut into slices of whole texts so that
the temporary arrays stay small whatever Arrow's batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20
_POW_LEN = 1 << 12
PIECE_BYTES = 1 << 17


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    values = mix64((lower.astype(U64) + U64(1)) * U64(_PRIME))
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    values[space] = 0
    return values, space


_VALUES, _SPACE = _byte_values()
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_POW_LEN, 0xD1342543DE82EF95, dtype=U64))
    # for short slices: powers over the whole slice, and what takes a word's start back out of them
    _RISING = np.cumprod(np.full(PIECE_BYTES, 0xD1342543DE82EF95, dtype=U64))
    _FALLING = np.cumprod(np.append(U64(1), np.full(PIECE_BYTES - 1, pow(0xD1342543DE82EF95, -1, 1 << 64), dtype=U64)))


CACHES: list = []  # what other operators' tasks left in this worker: functions that drop it


def give_back() -> None:
    """Return freed memory to the system; the C library would keep it in the worker, which outlives its tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget() -> None:
    """Drop what other operators' tasks left in this worker. Tasks name this function: a list named by them would reach the worker as a copy."""
    for clear in CACHES:
        clear()


def lean(run, drop: bool = True):
    """A task function that starts without other operators' caches (unless it uses them: ``drop`` false) and leaves no freed memory behind."""

    def task(batches):
        if drop:
            forget()
        give_back()
        yield from run(batches)
        give_back()

    return task


class Words(NamedTuple):
    """Words of one slice: hash, index of the text in the slice, and words per text."""

    hash: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array (null: empty), offsets relative to the returned bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) rows so that each slice holds at most ``limit`` bytes, or a single text."""
    _, offsets = utf8_parts(texts)
    at, n = 0, len(texts)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def word_table(texts: pa.Array) -> Words:
    """Words of every text, in text order."""
    data, offsets = utf8_parts(texts)
    n_docs = len(offsets) - 1
    if data.size == 0:
        return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64))
    space = _SPACE.take(data)
    starts = ~space
    edge = space.copy()
    edge[1:] = space[:-1]
    edge[0] = True
    inner = offsets[1:-1]
    edge[inner[inner < data.size]] = True
    starts &= edge
    at = np.flatnonzero(starts)
    if at.size == 0:
        return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64))
    spans = np.diff(np.append(at, data.size))
    values, place = _VALUES.take(data[at[0] :]), at - at[0]
    with np.errstate(over="ignore"):
        if values.size <= PIECE_BYTES and spans.max() <= _POW_LEN:
            values *= _RISING[: values.size]
            hashes = mix64(np.add.reduceat(values, place) * _FALLING.take(place))
        else:
            position = np.arange(at[0], data.size) - np.repeat(at, spans)
            values *= _POWERS.take(position & (_POW_LEN - 1))
            hashes = mix64(np.add.reduceat(values, place))
    doc = np.searchsorted(offsets, at, side="right") - 1
    return Words(hashes, doc, np.bincount(doc, minlength=n_docs))


def shingle_table(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every ``size``-word shingle, text by text, and shingles per text.

    A text with fewer words gives its whole word sequence as one shingle; a text without words none.
    """
    per_doc = np.where(words.per_doc >= size, words.per_doc - size + 1, np.minimum(words.per_doc, 1))
    total = int(per_doc.sum())
    if total == 0:
        return np.zeros(0, U64), per_doc
    first = np.cumsum(words.per_doc) - words.per_doc
    out_first = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    start = first[doc] + (np.arange(total) - out_first[doc])
    left = words.per_doc[doc]
    padded = np.append(words.hash, np.zeros(size, U64))
    with np.errstate(over="ignore"):
        h = np.full(total, 0x2545F4914F6CDD1D, dtype=U64)
        for k in range(size):
            step = mix64(h * U64(0x9FB21C651E98DF25) + padded[start + k])
            h = np.where(k < left, step, h) if k else step
    return h, per_doc


def code_point_count(texts: pa.Array) -> np.ndarray:
    """Unicode code points of every text (null: 0)."""
    data, offsets = utf8_parts(texts)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.diff(heads[offsets])


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_ends(texts: pa.Array, classes: int, which: np.ndarray | None = None) -> np.ndarray:
    """For every word of ``word_table`` (or those marked in ``which``), in order, a class of the last three bytes before its closing marks."""
    data, offsets = utf8_parts(texts)
    space = _SPACE.take(data)
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < data.size)]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    start, at = np.flatnonzero(first), np.flatnonzero(last)
    if which is not None:
        start, at = start[which], at[which]
    for _ in range(3):
        at = at - (_MARKS[data[at]] & (at > start))
    with np.errstate(over="ignore"):
        code = np.zeros(at.size, U64)
        for back, factor in ((0, 3), (1, 5), (2, 7)):
            code += np.where(at - back >= start, _VALUES[data[np.maximum(at - back, 0)]] * U64(factor), U64(0))
    return (mix64(code) % U64(classes)).astype(np.int64)


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of ``values``; an empty run gives 0."""
    out = np.zeros(len(lengths), dtype=values.dtype)
    filled = lengths > 0
    if filled.any():
        starts = np.cumsum(lengths) - lengths
        out[filled] = np.add.reduceat(values, starts[filled])
    return out


def distinct_per_doc(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order: (values, count of each, distinct per text)."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    values, counts, sizes = [], [], np.zeros(n_docs, np.int64)
    for i in range(n_docs):
        if bounds[i] < bounds[i + 1]:
            v = np.sort(value[bounds[i] : bounds[i + 1]])
            new = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            values.append(v[new])
            counts.append(np.diff(np.append(new, v.size)))
            sizes[i] = new.size
    if not values:
        return np.zeros(0, U64), np.zeros(0, np.int64), sizes
    return np.concatenate(values), np.concatenate(counts), sizes


def held_out(doc_ids: np.ndarray, modulus: int) -> np.ndarray:
    """True where crc32 of the decimal text of doc_id is divisible by ``modulus``."""
    import zlib

    return np.fromiter((zlib.crc32(str(int(i)).encode()) % modulus == 0 for i in doc_ids), dtype=bool, count=len(doc_ids))
