"""Language of words in mixed text: a linear-chain conditional random field.

A word's features are the word itself (the learned lexicon), its beginning and end and its
runs of two and three bytes, hashed into one table of weights per language. Weights and the
transitions between languages are learned together, by the gradient of the log-likelihood,
from segments of labelled texts put end to end, so that languages do switch in training.
Forward-backward then gives every word of a text its probabilities; the text's language is
the one with the greatest sum, and its score that sum's share.

Learned from a bounded sample: about `PER_LANGUAGE` rows a language and `TRAIN_ROWS` in all,
chosen by hash. Every text is labelled whole.

Defined results: `und` with score 0 for a text that is null or has no letter, and for every
text when nothing is labelled; a null lang is not learned from; rows may repeat; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.folds import held_out
from pagespark.llm.textbytes import find_words, mix, owners, span_hashes, text_chunks
from pagespark.llm.toxicity import NOT_LETTER, folded

PER_LANGUAGE, TRAIN_ROWS, LANGUAGES = 400, 3000, 1000
SEGMENTS, SEGMENT_WORDS, SEQUENCE_SEGMENTS = 4, 40, 4  # of a training text; of a training sequence
SLOT_BITS = 16
STEPS, RIDGE = 60, 1e-5
UNKNOWN = "und"
DDL = "doc_id bigint, lang_pred string, score double, n_words bigint, n_switches bigint"


def word_slots(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of the weight table, word) of every feature of every word."""
    shift = np.uint64(64 - SLOT_BITS)
    n, words = len(starts), np.arange(len(starts))
    slots, own = [span_hashes(low, starts, ends) >> shift], [words]
    for size in (1, 2, 3):
        longer = ends - starts > size
        slots.append(mix(span_hashes(low, starts[longer], starts[longer] + size) + np.uint64(size)) >> shift)
        slots.append(mix(span_hashes(low, ends[longer] - size, ends[longer]) + np.uint64(16 + size)) >> shift)
        own += [words[longer], words[longer]]
    if len(low) and n:
        wide = low.astype(np.uint64)
        padded = np.concatenate((wide, np.zeros(2, np.uint64)))
        two = wide + (padded[1:-1] << np.uint64(8))
        three = two + (padded[2:] << np.uint64(16))
        for size, grams in ((2, two), (3, three)):
            count = np.maximum(ends - starts - size + 1, 0)
            word = np.repeat(words, count)
            at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + starts[word]
            slots.append(mix(grams[at] + np.uint64(size << 32)) >> shift)
            own.append(word)
    return np.concatenate(slots).astype(np.int64), np.concatenate(own)


def emissions(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features; equal words are computed once."""
    if not len(starts):
        return np.zeros((0, table.shape[1]))
    _, first, at = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(starts[first], kind="stable")  # spans in order, for the hashes of their parts
    slots, words = word_slots(low, starts[first][order], ends[first][order])
    sums = np.stack([np.bincount(words, table[slots, k], minlength=len(first)) for k in range(table.shape[1])], axis=1)
    unsorted = np.empty_like(sums)
    unsorted[order] = sums
    return unsorted[at]


def forward_backward(scores: np.ndarray, firsts: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Probabilities of each word's language in many texts at once. With ``pairs``, also the
    expected number of each transition and the log-likelihood's normaliser summed over texts."""
    k = scores.shape[1]
    top = scores.max(axis=1, keepdims=True) if len(scores) else np.zeros((0, 1))
    emit = np.exp(scores - top)
    step = np.exp(transition)
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    begin = firsts[:-1][order]
    longest = int(lengths.max()) if len(lengths) else 0
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts longer than t
    alpha, scale = np.empty_like(emit), np.ones(len(emit))
    state = np.full((int(active[0]) if longest else 0, k), 1.0 / k)
    for t in range(longest):
        at = begin[:active[t]] + t
        state = (state[:active[t]] @ step if t else state) * emit[at]
        total = state.sum(axis=1)
        state = state / total[:, None]
        alpha[at], scale[at] = state, total
    beta = np.ones((len(lengths), k))
    out = np.empty_like(emit)
    expected = np.zeros((k, k))
    for t in range(longest - 1, -1, -1):
        at = begin[:active[t]] + t
        out[at] = alpha[at] * beta[:active[t]]
        if t:
            carried = emit[at] * beta[:active[t]] / scale[at][:, None]
            if pairs:
                expected += (alpha[at - 1].T @ carried) * step
            beta[:active[t]] = carried @ step.T
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
    if pairs:
        return out, expected, float(np.log(scale).sum() + top.sum())
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    transition: np.ndarray

    def label(self, data: np.ndarray, offsets: np.ndarray):
        """Sums of probabilities per text and language, and the number of switches."""
        low = folded(data)
        starts, ends, firsts = find_words(low, offsets, NOT_LETTER)
        n = len(offsets) - 1
        chance = forward_backward(emissions(low, starts, ends, self.table), firsts, self.transition)
        texts = owners(firsts)
        sums = np.stack([np.bincount(texts, chance[:, k], minlength=n) for k in range(len(self.languages))], axis=1)
        best = chance.argmax(axis=1) if len(chance) else np.zeros(0, int)
        change = (best[1:] != best[:-1]) & (texts[1:] == texts[:-1])
        return sums, np.diff(firsts), np.bincount(texts[1:][change], minlength=n)


def train(rows: list[tuple[int, str, str]], steps: int = STEPS, ridge: float = RIDGE) -> Model | None:
    """Learn from (key, text, language) rows."""
    languages = sorted({lang for _, _, lang in rows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    segments: list[tuple[int, list[bytes]]] = []
    for key, text, lang in rows:
        low = folded(np.frombuffer(text.encode(), dtype=np.uint8))
        starts, ends, _ = find_words(low, np.array([0, len(low)]), NOT_LETTER)
        for s in range(min(SEGMENTS, -(-len(starts) // SEGMENT_WORDS))):
            room = max(len(starts) - SEGMENT_WORDS, 0)
            a = int(mix(np.array([key * 31 + s & (1 << 63) - 1], dtype=np.uint64))[0] % np.uint64(room + 1))
            segments.append((number[lang], [low[i:j].tobytes() for i, j in zip(starts[a:a + SEGMENT_WORDS], ends[a:a + SEGMENT_WORDS])]))
    random = np.random.default_rng(1)
    segments = [segments[i] for i in random.permutation(len(segments))]
    words: dict[bytes, int] = {}
    tokens, truth, firsts = [], [], [0]
    for i, (lang, own) in enumerate(segments):
        tokens += [words.setdefault(w, len(words)) for w in own]
        truth += [lang] * len(own)
        if i % SEQUENCE_SEGMENTS == SEQUENCE_SEGMENTS - 1 or i == len(segments) - 1:
            firsts.append(len(tokens))
    k, size = len(languages), 1 << SLOT_BITS
    table, transition = np.zeros((size, k)), np.zeros((k, k))
    if not tokens or k == 1:
        return Model(languages, table.astype(np.float32), transition)
    tokens, truth, firsts = np.array(tokens), np.array(truth), np.array(firsts)
    joined = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts, ends, _ = find_words(joined, np.array([0, len(joined)]), NOT_LETTER)
    slots, owner = word_slots(joined, starts, ends)
    real = np.zeros((k, k))
    inner = np.ones(len(tokens), dtype=bool)
    inner[firsts[:-1][firsts[:-1] < len(tokens)]] = False
    np.add.at(real, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    hot = np.eye(k)[truth]
    state = [np.zeros_like(table), np.zeros_like(table), np.zeros((k, k)), np.zeros((k, k))]
    for step in range(1, steps + 1):
        per_word = np.stack([np.bincount(owner, table[slots, j], minlength=len(words)) for j in range(k)], axis=1)
        chance, expected, _ = forward_backward(per_word[tokens], firsts, transition, pairs=True)
        wrong = (chance - hot) / len(tokens)
        by_word = np.stack([np.bincount(tokens, wrong[:, j], minlength=len(words)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(slots, by_word[owner, j], minlength=size) for j in range(k)], axis=1) + ridge * table
        turn = (expected - real) / len(tokens)
        for own, g, at in ((table, grad, 0), (transition, turn, 2)):
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            own -= 0.1 * (state[at] / (1 - 0.9 ** step)) / (np.sqrt(state[at + 1] / (1 - 0.99 ** step)) + 1e-9)
    return Model(languages, table.astype(np.float32), transition)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from labelled rows outside the held-out fold; common languages are thinned by hash."""
    known = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id")), 11).cast("double") / F.lit(float(1 << 53))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    sample = known.withColumn("_draw", draw).filter(F.col("_draw") < F.get(F.map_values(share), F.array_position(F.map_keys(share), F.col("lang")).cast("int") - 1))
    chosen = sample.orderBy("_draw", "doc_id").limit(rows).collect()
    return train([(r["doc_id"] or 0, r["text"], r["lang"]) for r in chosen])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """lang_pred, score, n_words and n_switches of every row."""
    # plain arrays, so that a worker needs no module of this library to read them
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.table, model.transition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value and Model(*sent.value)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch, limit=3 << 20):
                n = end - first
                if model is None:
                    columns = [[UNKNOWN] * n, np.zeros(n), np.zeros(n, int), np.zeros(n, int)]
                else:
                    sums, count, switches = model.label(data, offsets)
                    best = sums.argmax(axis=1)
                    langs = [model.languages[b] for b in best]
                    score = sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1e-300)
                    ascii_letters = np.concatenate(([0], np.cumsum((data | 32) - 97 < 26)))
                    for i in np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]):
                        if not any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")):
                            langs[i], score[i] = UNKNOWN, 0.0
                    columns = [langs, np.clip(score, 0.0, 1.0), count, switches]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array(columns[0], type=pa.string()), pa.array(columns[1], type=pa.float64()),
                    pa.array(columns[2], type=pa.int64()), pa.array(columns[3], type=pa.int64())],
                    names=["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DDL)
