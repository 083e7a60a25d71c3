"""Toxicity: logistic regression on words and word beginnings, regularised by counterfactuals.

Features are whole words and their first bytes. Those that labelled toxic documents hold
markedly more often than others get a weight. Where a labelled sentence names an identity
group, every other term of its group is put in its place and the square of the score change
is a penalty, so that naming a group neutrally does not raise the score.

Only a bounded sample of labelled rows (`SAMPLE` rows, chosen by hash) and the bounded list of
chosen features (`FEATURES`) reach the driver; every document is scored, over its whole text.

Defined results: a null or empty text has the score of a text without evidence; labels that
are null are not learned from; a doc_id labelled twice counts as toxic if one label says so;
without any toxic label every score is the share of toxic labels, which is 0. Rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.folds import bounded_sample, held_out
from pagespark.llm.textbytes import LOWER, find_words, owners, span_hashes, text_chunks
from pagespark.session import written

SAMPLE = 20_000  # labelled rows learned from
FEATURES = 20_000  # features that may get a weight
THRESHOLD = 0.3
LEAST_TOXIC, LEAST_SHARE = 3, 0.01  # a feature's toxic rows: so many, and this share of all toxic rows
LEAST_PRECISION = 0.6  # share of a feature's rows that are toxic
RIDGE, SWAP_PENALTY, STEPS = 1e-3, 10.0, 300
PREFIXES = (4, 5, 6, 7, 8)

# Terms that name groups of people; terms of one row may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)

NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[97:123] = NOT_LETTER[0x80:] = False

SEEN_DDL = "feature bigint, n bigint, toxic bigint"
ROWS_DDL = "doc_id bigint, toxic int, features array<bigint>, swaps array<array<bigint>>"
SCORE_DDL = "doc_id bigint, score double"


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-case Latin letters, those of two bytes too."""
    out = LOWER[data]
    if len(out) > 1:
        second = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every word: the word itself, then its beginnings where it is longer."""
    low = folded(data)
    starts, ends, firsts = find_words(low, offsets, NOT_LETTER)
    texts = owners(firsts)
    out, own = [span_hashes(low, starts, ends)], [texts]
    for size in PREFIXES:
        longer = ends - starts > size
        out.append(span_hashes(low, starts[longer], starts[longer] + size) ^ np.uint64(size))
        own.append(texts[longer])
    return np.concatenate(out).view(np.int64), np.concatenate(own)


def word_features(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return np.unique(features_of(raw, np.array([0, len(raw)]))[0])


def distinct_pairs(features: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, texts))
    features, texts = features[order], texts[order]
    new = np.ones(len(features), dtype=bool)
    new[1:] = (features[1:] != features[:-1]) | (texts[1:] != texts[:-1])
    return features[new], texts[new]


@dataclass
class Model:
    """Chosen features in order, their weights, and the score without evidence as a log odds."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, dtype=bool)  # most features of a text end here
        self.seen[self.features.view(np.uint64) >> np.uint64(44)] = True

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        if not len(self.features):
            return out
        features, texts = features_of(data, offsets)
        near = self.seen[features.view(np.uint64) >> np.uint64(44)]
        features, texts = features[near], texts[near]
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        hit = self.features[at] == features
        at, texts = distinct_pairs(at[hit], texts[hit])
        return out + np.bincount(texts, self.weights[at], minlength=len(out))

    def score_text(self, text: str | None) -> float:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return float(sigmoid(self.logits(raw, np.array([0, len(raw)])))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50.0, 50.0)))


def train(rows: Sequence[tuple[int, np.ndarray, list]], chosen: np.ndarray, ridge: float = RIDGE,
          swap_penalty: float = SWAP_PENALTY, steps: int = STEPS) -> Model:
    """Full-batch Adam on ``(toxic, features, swaps)`` rows; a swap is a pair (lost, gained) of features."""
    n = len(rows)
    y = np.array([r[0] for r in rows], dtype=float)
    if not n or not y.any():
        return Model()
    if not len(chosen):
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        return Model(bias=float(np.log(rate / (1 - rate))))

    def place(values: np.ndarray) -> np.ndarray:
        values = np.asarray(values, dtype=np.int64)
        at = np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)
        return at[chosen[at] == values]

    columns = [np.unique(place(r[1])) for r in rows]
    row = np.repeat(np.arange(n), [len(c) for c in columns])
    column = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    pairs = [(place(lost), place(gained)) for r in rows for lost, gained in r[2]]
    pair = np.concatenate([np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])]) if pairs else np.zeros(0, np.int64)
    pair_column = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.zeros(0, np.int64)
    pair_sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    w, b = np.zeros(len(chosen)), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        error = (sigmoid(np.bincount(row, w[column], minlength=n) + b) - y) / n
        grad = np.bincount(column, error[row], minlength=len(w)) + 2 * ridge * w / len(w) ** 0.5
        if len(pairs):
            change = np.bincount(pair, pair_sign * w[pair_column], minlength=len(pairs))
            grad += 2 * swap_penalty / len(pairs) * np.bincount(pair_column, pair_sign * change[pair], minlength=len(w))
        full = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, b)


def swaps_of(present: set[int], terms: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each identity term among the features, the features lost and gained by every other term of its row."""
    out = []
    for group in terms:
        for term in group:
            if len(term) and all(int(f) in present for f in term):
                for other in group:
                    if other is not term:
                        out.append((np.setdiff1d(term, other), np.setdiff1d(other, term)))
    return out


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins and ends in the values of all."""
    return column.offsets.to_numpy(), column.values


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
        swap_penalty: float = SWAP_PENALTY, identity=IDENTITY_TERMS) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    marks = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen_rows = F.broadcast(bounded_sample(marks, sample))  # at most `sample` rows of 12 bytes
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen_rows, "doc_id")
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not totals["toxic"]:
        return Model()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy()
            for first, _, data, offsets in text_chunks(batch):
                values, texts = distinct_pairs(*features_of(data, offsets))
                kinds, at = np.unique(values, return_inverse=True)
                bad = toxic[first:][texts] > 0
                n = np.bincount(at, minlength=len(kinds))
                worse = np.bincount(at, bad, minlength=len(kinds)).astype(np.int64)
                kept = worse > 0
                yield pa.RecordBatch.from_arrays([pa.array(kinds[kept]), pa.array(n[kept]), pa.array(worse[kept])], names=["feature", "n", "toxic"])

    # Counts over rows with no toxic one among them matter only for features met in toxic rows elsewhere.
    toxic_features = known.filter("toxic > 0").mapInArrow(seen, SEEN_DDL).groupBy("feature").agg(F.sum("toxic").alias("toxic"))
    frequent = toxic_features.filter(F.col("toxic") >= min(max(LEAST_TOXIC, int(LEAST_SHARE * totals["toxic"])), totals["toxic"]))
    top = frequent.orderBy(F.desc("toxic"), "feature").limit(8 * features).collect()  # bounded
    candidates = np.sort(np.array([r["feature"] for r in top], dtype=np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(candidates)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = [[word_features(t) for t in group] for group in identity]
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                values, texts = distinct_pairs(*features_of(data, offsets))
                cuts = np.searchsorted(texts, np.arange(end - first + 1))
                own, swapped = [], []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    present = values[a:b]
                    own.append(np.intersect1d(present, sent.value, assume_unique=True))
                    pairs = swaps_of(set(present.tolist()), terms) if identity else []
                    swapped.append([x for p in pairs for x in p])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first),
                    pa.array(own, type=pa.list_(pa.int64())), pa.array(swapped, type=pa.list_(pa.list_(pa.int64())))],
                    names=["doc_id", "toxic", "features", "swaps"])

    learned = written(known.mapInArrow(rows, ROWS_DDL), "learned")  # read twice; no task runs two Python workers in a row
    counts = learned.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    lifted = counts.filter((F.col("toxic") / F.col("n")) >= LEAST_PRECISION)
    best = lifted.orderBy(F.desc(F.col("toxic") * F.col("toxic") / F.col("n")), "feature").limit(features).collect()
    chosen = np.sort(np.array([r["feature"] for r in best], dtype=np.int64))
    kept = docs.sparkSession.sparkContext.broadcast(chosen)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(np.asarray(x or [], dtype=np.int64), kept.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, type=pa.list_(pa.int64())), batch.column(3)],
                                             names=["doc_id", "toxic", "features", "swaps"])

    found = learned.mapInArrow(narrowed, ROWS_DDL).toArrow()  # at most `sample` rows of chosen features, as plain arrays
    toxic = found["toxic"].to_numpy()
    features_at, own = _lists(found["features"].combine_chunks())
    swaps_at, swaps = _lists(found["swaps"].combine_chunks())
    swap_at, swapped = _lists(swaps)
    own, swapped = own.to_numpy(), swapped.to_numpy()
    data = []
    for i in np.lexsort((np.diff(features_at), found["doc_id"].to_numpy())).tolist():
        flat = [swapped[swap_at[k]:swap_at[k + 1]] for k in range(swaps_at[i], swaps_at[i + 1])]
        data.append((int(toxic[i] > 0), own[features_at[i]:features_at[i + 1]], list(zip(flat[::2], flat[1::2]))))
    return train(data, chosen, swap_penalty=swap_penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sigmoid(own.logits(data, offsets)))],
                                                 names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCORE_DDL)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                clean = sigmoid(own.logits(data, offsets)) < threshold
                yield batch.slice(first, end - first).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
