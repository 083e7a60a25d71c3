"""Fill-in-the-middle: a text is cut at two unit boundaries and its parts change places behind markers.

The bytes of many whole texts are mapped to eight character classes and indexed by a wavelet
matrix of three levels. Rank queries at the texts' ends give how many units each text has (ranks of
the classes that end a unit, added up) and how many code points lie between two places (all bytes but
those that continue a character). A cut after k units is a select where one class ends a unit, else a
bisection on the added ranks; both run for all texts of a run at once.

Defined results: a null text is an empty one; an empty text, one that holds a marker and one left out
by the draw stay as they are (form ``plain``); a null doc_id draws as empty text; rows that share a
doc_id draw alike; every row gives a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.llm.textbytes import text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE, BLANK, DIGIT, LOWER, UPPER, SIGN, LEAD, FOLLOW = range(8)  # classes of bytes
BITS = 3

CLASS = np.full(256, SIGN, dtype=np.uint8)
CLASS[10] = NEWLINE
CLASS[[32, 9, 11, 12, 13]] = BLANK
CLASS[48:58], CLASS[97:123], CLASS[65:91] = DIGIT, LOWER, UPPER
CLASS[128:192], CLASS[192:] = FOLLOW, LEAD

UNITS = {"line": (NEWLINE,), "word": (NEWLINE, BLANK)}  # classes whose byte ends a unit

DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class BitRow:
    """Bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((self.size >> 6) + 1, dtype=np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def rank(self, bit: int, at: np.ndarray) -> np.ndarray:
        return self.ones(at) if bit else at - self.ones(at)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the bit that has k equal ones before it."""
        return bisect(lambda at: self.rank(bit, at), k + 1, np.zeros_like(k), np.full_like(k, self.size)) - 1


def bisect(count, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least place in [low, high] whose count reaches the wanted one; counts never fall."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        enough = count(mid) >= wanted
        high = np.where(open_ & enough, mid, high)
        low = np.where(open_ & ~enough, mid + 1, low)
    return low


class WaveletMatrix:
    """Rank and select of small classes; each level sorts stably by one bit, the highest first."""

    def __init__(self, classes: np.ndarray, bits: int = BITS):
        self.bits, self.size = bits, len(classes)
        self.rows: list[BitRow] = []
        self.zeros: list[int] = []
        for level in range(bits):
            bit = ((classes >> (bits - 1 - level)) & 1).astype(bool)
            self.rows.append(BitRow(bit))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            classes = np.concatenate((classes[~bit], classes[bit]))

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for level, row in enumerate(self.rows):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = row.rank(bit, at) + (self.zeros[level] if bit else 0)
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the class stands in the first ``at`` places."""
        at = np.asarray(at, dtype=np.int64)
        return self._down(symbol, at) - self._down(symbol, np.zeros(1, dtype=np.int64))

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the occurrence that has k before it; it must exist."""
        at = self._down(symbol, np.zeros(1, dtype=np.int64)) + np.asarray(k, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = self.rows[level].select(bit, at - (self.zeros[level] if bit else 0))
        return at


class Cutter:
    """Units and cuts of the texts of one run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "line"):
        self.enders = UNITS[unit]
        self.matrix = WaveletMatrix(CLASS[data])
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.before = self.boundaries(self.starts)
        self.closed = self.boundaries(self.ends) - self.before  # units with an end of their own
        last = CLASS[data[np.maximum(self.ends - 1, 0)]] if len(data) else np.zeros(len(self.ends), np.uint8)
        self.units = self.closed + ((self.ends > self.starts) & ~np.isin(last, self.enders))

    def boundaries(self, at: np.ndarray) -> np.ndarray:
        """Unit ends among the first ``at`` bytes."""
        return sum(self.matrix.rank(c, at) for c in self.enders)

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points among the first ``at`` bytes, at whole characters."""
        return at - self.matrix.rank(FOLLOW, at)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Byte after the first k units of each text."""
        out = np.where(k > self.closed, self.ends, self.starts)
        inner = np.flatnonzero((k > 0) & (k <= self.closed))
        wanted = self.before[inner] + k[inner]
        if len(self.enders) == 1:
            out[inner] = self.matrix.select(self.enders[0], wanted - 1) + 1
        else:
            out[inner] = bisect(self.boundaries, wanted, self.starts[inner], self.ends[inner])
        return out


def draws(seed: int, key: Column) -> list[Column]:
    """Four numbers below 2**32 from the key: the first groups of eight hex digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", changed: int = 100, spm: int = 50) -> DataFrame:
    """Per row: doc_id, units n, form, code points of prefix and middle, and the text as cut and marked.
    Of 100 documents ``changed`` are cut, of those ``spm`` with the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
            drawn = [batch.column(2 + i).to_numpy() for i in range(4)]
            for first, end, data, offsets in text_chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first),
                     *rearranged(data, offsets, [h[first:end] for h in drawn], marked[first:end], unit, changed, spm)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    numbers = [h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col("doc_id")))]
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *numbers).mapInArrow(run, DDL)


def rearranged(data: np.ndarray, offsets: np.ndarray, drawn: list[np.ndarray], marked: np.ndarray,
               unit: str, changed: int, spm: int) -> list[pa.Array]:
    """Columns of one run of texts."""
    cutter = Cutter(data, offsets, unit)
    n = cutter.units
    one, two = drawn[0] % (n + 1), drawn[1] % (n + 1)
    a, b = cutter.cut(np.minimum(one, two)), cutter.cut(np.maximum(one, two))
    plain = (cutter.ends == cutter.starts) | marked | (drawn[2] % 100 >= changed)
    suffix_first = drawn[3] % 100 < spm
    whole = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    outputs = []
    for start, i, j, stop, keep, spm_form in zip(cutter.starts.tolist(), a.tolist(), b.tolist(), cutter.ends.tolist(), plain, suffix_first):
        if keep:
            outputs.append(whole[start:stop])
        elif spm_form:
            outputs.append(b"".join((s, whole[j:stop], p, whole[start:i], m, whole[i:j])))
        else:
            outputs.append(b"".join((p, whole[start:i], s, whole[j:stop], m, whole[i:j])))
    at_a = cutter.points(a)
    return [
        pa.array(n, type=pa.int64()),
        pa.array(np.where(plain, "plain", np.where(suffix_first, "spm", "psm")).tolist(), type=pa.string()),
        pa.array(at_a - cutter.points(cutter.starts), mask=plain, type=pa.int64()),
        pa.array(cutter.points(b) - at_a, mask=plain, type=pa.int64()),
        pa.array(outputs, type=pa.binary()).cast(pa.string()),
    ]


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. No marker stands in a cut text, so each is found where it was put."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        body = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(body, MIDDLE, 1)
        return one, two, F.substr(body, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
