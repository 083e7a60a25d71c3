"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

Every window of `window` consecutive item words (a shorter item is one window) must occur
whole, so the set of its shingles must be contained whole. One shingle is then a sufficient
prefix, and the rarest one, by count over all documents, is the cheapest. Documents emit a
row only where one of their shingles may be some window's prefix; the join on that token is
followed by the length and position bounds and by comparing all words of the window.

Defined results: a null or empty text has no words and is clean; a null or empty item has no
window; rows that share a doc_id keep a row each; an item listed twice counts once; an item
without id is not listed. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.bitmaps import bitmap_of, maybe_in
from pagespark.llm.textbytes import (
    LOWER, NOT_ALNUM, find_words, inside_windows, owners, span_hashes, text_chunks, window_hashes,
)
from pagespark.session import written

WINDOW = 10
SHINGLE = 5  # words in a prefix token

WINDOWS_DDL = "item_id bigint, words array<string>, place int, size int, token bigint"
COUNTS_DDL = "token bigint, n bigint"
FOUND_DDL = "doc_id bigint, n_words bigint, found array<struct<token: bigint, pos: int, at: int, words: array<string>>>"


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per item, window and shingle in it: the shingle's place, length and hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in text_chunks(batch):
                folded = LOWER[data]
                starts, ends, firsts = find_words(folded, offsets, NOT_ALNUM)
                hashes = span_hashes(folded, starts, ends)
                raw = folded.tobytes()
                rows = []
                for i in range(end - first):
                    a, b = int(firsts[i]), int(firsts[i + 1])
                    words = [raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])]
                    size = min(window, b - a)
                    part = min(shingle, size)
                    tokens = window_hashes(hashes[a:b], part).view(np.int64) if size else []
                    for at in range(b - a - size + 1 if size else 0):
                        for k in range(size - part + 1):
                            rows.append((ids[first + i], words[at:at + size], k, part, int(tokens[at + k])))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(zip(*rows), (
                            pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64()))],
                        names=["item_id", "words", "place", "size", "token"])

    chosen = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return chosen.mapInArrow(cut, WINDOWS_DDL)


def document_tokens(hashes: np.ndarray, firsts: np.ndarray, sizes: list[int], bitmap: np.ndarray):
    """(token, first word) of the shingles that pass the filter, for every size in use."""
    tokens, places = [], []
    for size in sizes:
        windows = window_hashes(hashes, size)
        at = inside_windows(firsts, size)
        at = at[maybe_in(bitmap, windows[at])]
        tokens.append(windows[at])
        places.append(at)
    return np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), np.concatenate(places) if places else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """How often each filtered shingle occurs over all documents; summed in tasks before the shuffle."""
    kept = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                folded = LOWER[data]
                starts, ends, firsts = find_words(folded, offsets, NOT_ALNUM)
                tokens, _ = document_tokens(span_hashes(folded, starts, ends), firsts, sizes, kept.value)
                tokens, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    return docs.select("text").mapInArrow(count, COUNTS_DDL).groupBy("token").agg(F.sum("n").alias("n"))


def prefix_candidates(docs: DataFrame, sizes: list[int], bitmap: np.ndarray, window: int = WINDOW) -> DataFrame:
    """One row per document: its words counted, and where a prefix token may be, with the words around it."""
    kept = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()),
                                   ("words", pa.list_(pa.string()))]))
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in text_chunks(batch):
                folded = LOWER[data]
                starts, ends, firsts = find_words(folded, offsets, NOT_ALNUM)
                tokens, places = document_tokens(span_hashes(folded, starts, ends), firsts, sizes, kept.value)
                texts = owners(firsts)
                found: list[list] = [[] for _ in range(end - first)]
                for token, at in zip(tokens.view(np.int64).tolist(), places.tolist()):
                    i = int(texts[at])
                    low = max(int(firsts[i]), at - window + 1)
                    high = min(int(firsts[i + 1]), at + window)
                    words = [folded[starts[k]:ends[k]].tobytes().decode() for k in range(low, high)]
                    found[i].append({"token": token, "pos": at - int(firsts[i]), "at": at - low, "words": words})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(np.diff(firsts)), pa.array(found, type=kind)],
                    names=["doc_id", "n_words", "found"])

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return chosen.mapInArrow(find, FOUND_DDL)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, hits (distinct ``struct(start, size)`` of the windows found,
    in words) and items (distinct ids of the items they belong to)."""
    windows = written(item_windows(items, window, shingle), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `shingle` numbers
    counts = token_counts(docs, sizes, bitmap_of(windows, "token"))
    rarest = F.min_by(F.struct("token", "place", "size"), F.struct("n", "token", "place"))
    prefixes = (
        windows.drop("item_id").distinct().join(counts.hint("merge"), "token", "left")
        .groupBy("words").agg(F.count("n").alias("_known"), F.count("*").alias("_all"), rarest.alias("p"))
        .filter("_known = _all")  # a shingle that no document has: the window occurs nowhere
        .select("words", F.col("p.token").alias("token"), F.col("p.place").alias("place"))
    )
    prefixes = written(prefixes, "prefixes")
    base = written(prefix_candidates(docs, sizes, bitmap_of(prefixes, "token"), window)
                   .withColumn("_row", F.monotonically_increasing_id()), "candidates")
    spots = base.select("_row", F.explode("found").alias("f")).select("_row", "f.token", "f.pos", "f.at", F.col("f.words").alias("near"))
    long = F.size("words")
    begin = F.col("at") - F.col("place")
    matched = (
        spots.hint("merge").join(prefixes.hint("merge"), "token")
        .filter((F.col("pos") >= F.col("place")) & (begin >= 0) & (begin + long <= F.size("near")))
        .filter(F.slice("near", begin + 1, long) == F.col("words"))
        .select("_row", "words", (F.col("pos") - F.col("place")).alias("start"), long.alias("size"))
    )
    matched = written(matched, "matched")
    owned = windows.select("words", "item_id").distinct()
    listed = (
        matched.select("_row", "words").distinct().hint("merge").join(owned.hint("merge"), "words")
        .groupBy("_row").agg(F.collect_set("item_id").alias("items"))
    )
    spans = matched.groupBy("_row").agg(F.collect_set(F.struct("start", "size")).alias("hits"))
    return (
        base.select("_row", "doc_id", "n_words").join(spans, "_row", "left").join(listed, "_row", "left")
        .select("doc_id", "n_words", F.coalesce("hits", F.expr("array()")).alias("hits"),
                F.coalesce("items", F.expr("array()")).alias("items"))
    )


def hit_words(hits):
    """Number of words inside any hit."""
    runs = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))
    return F.size(F.array_distinct(F.flatten(runs))).cast("bigint")
