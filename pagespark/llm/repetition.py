"""Quality rules: how much of a text lies inside repeated lines and repeated n-grams.

Rolling hashes of each n-gram length are compared inside each text, and the characters of
every n-gram that stood earlier in the text are marked; a rule per length bounds the share of
marked characters. All of it is numpy over many whole texts at once.

Defined results: a null text is an empty one, with all counts zero and too few words to keep;
a text without words has shares of zero; every row gives a row, repeated or not. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.textbytes import (
    BLANK, find_words, inside_windows, owners, span_hashes, text_chunks, window_hashes,
)

MIN_WORDS = 50
MAX_REPEAT_WORDS = 50  # per cent of words inside a 3-word window found twice or more
LINE_SHARE = 0.30  # of characters in lines seen before
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}  # of characters in repeated n-grams

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
SHARES = ["line_share", *[f"share_{n}" for n in NGRAM_SHARES]]
DDL = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
       + ", ".join(f"{s} double" for s in SHARES))


def _per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeats(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its text, is not the first of its kind) for each hash."""
    keys = hashes ^ (texts.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))  # one sort instead of two
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def _covered(firsts: np.ndarray, hashes: np.ndarray, texts: np.ndarray, size: int, first_too: bool = False) -> np.ndarray:
    """Whether each word lies in a window of `size` words that its text held before, or, with
    ``first_too``, holds twice or more."""
    n = len(hashes)
    at = inside_windows(firsts, size)
    twice, later = _repeats(window_hashes(hashes, size)[at], texts[at])
    at = at[twice if first_too else later]
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The measured columns of each text, in the order of DDL without doc_id."""
    starts, ends, firsts = find_words(data, offsets, BLANK)
    hashes, texts = span_hashes(data, starts, ends), owners(firsts)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = begins[ends] - begins[starts]
    char_sum = np.concatenate(([0], np.cumsum(chars)))
    word_chars = char_sum[firsts[1:]] - char_sum[firsts[:-1]]

    def chars_in(marked: np.ndarray) -> np.ndarray:
        return _per_text(np.where(marked, chars, 0), firsts)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_texts = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_texts + 1])
    line_ends = line_ends - ((line_ends > line_starts) & (data[np.maximum(line_ends, 1) - 1] == 10))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_texts = line_starts[worded], line_ends[worded], line_texts[worded]
    _, later = _repeats(span_hashes(data, line_starts, line_ends), line_texts)
    dup_lines = np.bincount(line_texts[later], minlength=len(offsets) - 1)
    in_line = np.zeros(len(starts) + 1, dtype=np.int32)
    np.add.at(in_line, np.searchsorted(starts, line_starts[later]), 1)
    np.add.at(in_line, np.searchsorted(starts, line_ends[later]), -1)
    whole = np.maximum(word_chars, 1)
    shares = [chars_in(np.cumsum(in_line[:-1]) > 0) / whole]
    shares += [chars_in(_covered(firsts, hashes, texts, n)) / whole for n in NGRAM_SHARES]
    repeat_words = _per_text(_covered(firsts, hashes, texts, 3, first_too=True), firsts)
    return [np.diff(firsts), word_chars, _per_text(SYMBOL[data], offsets), dup_lines, repeat_words, *shares]


def repetition(docs: DataFrame) -> DataFrame:
    """Counts and shares of every document."""
    names = [c.split()[0] for c in DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                columns = [pa.array(c) for c in measure(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *columns], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DDL)


def judged(measured: DataFrame) -> DataFrame:
    """base_failed by words and 3-word repeats; kept also needs every share within its bound."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))
    fine = F.col("line_share") <= LINE_SHARE
    for n, most in NGRAM_SHARES.items():
        fine = fine & (F.col(f"share_{n}") <= most)
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & fine)
