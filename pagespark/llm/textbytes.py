"""Whole columns of text as one byte array: words, hashes and shingles with numpy.

Every function takes the UTF-8 bytes of many texts laid end to end with the offsets
where each text begins, as Arrow stores them. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
PRIME = 0x9E3779B97F4A7C15  # odd, so multiplication mod 2**64 is invertible
STEP = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20  # texts handled together; a longer text is handled alone

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLANK = np.zeros(256, dtype=bool)  # space, tab to carriage return
BLANK[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.ones(256, dtype=bool)  # a word is digits, lower-case letters, anything past ASCII
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: hand Python fewer of them at a time, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; limit bounds a run unless it is one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=width)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        cut = offsets[first:end + 1]
        yield first, end, data[cut[0]:cut[-1]], cut - cut[0]
        first = end


def find_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, per text, the index of its first word (one more entry than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(blank[data], out=inside[1:n + 1])
    change = inside[1:] != inside[:-1]
    bounds = np.zeros(n + 1, dtype=bool)
    bounds[offsets] = True
    starts = np.flatnonzero((change | bounds) & inside[1:])
    ends = np.flatnonzero((change | bounds) & inside[:-1])
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, base: int = PRIME) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans lie in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    at = np.arange(len(first))
    inside = np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    values = (data[at + first].astype(U64) + U64(1)) * powers(int(lengths.max()))[at - inside]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1]))) if lengths.min() > 0 else _sums(values, lengths)
    return mix(sums + lengths.astype(U64) * U64(STEP))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    at = np.concatenate(([0], np.cumsum(lengths)))
    return total[at[1:]] - total[at[:-1]]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbouring word hashes, text ends not minded."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for k, p in enumerate(powers(size, STEP)):
        out += words[k:k + n] * p
    return mix(out + U64(size))


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text of each word, from the index of each text's first word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def inside_windows(firsts: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of `size` words that end in the text where they begin."""
    n = int(firsts[-1])
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
    return np.flatnonzero(left >= size)


def shingle_texts(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, sorted, after A-Z are lower-cased. A text with fewer than
    `size` words, but not none, has one shingle of all its words."""
    folded = LOWER[data]
    starts, ends, firsts = find_words(folded, offsets, blank)
    words = span_hashes(folded, starts, ends)
    windows = window_hashes(words, size)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= size:
            own = np.sort(windows[a:b - size + 1])
            new = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        else:
            yield window_hashes(words[a:b], b - a) if b > a else np.zeros(0, dtype=U64)
