"""Script choice, language scores and other per-sample scores, in long form."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.session import written

from pagespark.functions.scores import linear_score


def _rank(column: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), column)


def argmax_first(scores: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "script", score: str = "score") -> DataFrame:
    """Name with the top score; the first in order wins a tie."""
    best = F.struct(F.col(score), -_rank(F.col(name), order))
    return scores.groupBy(*key).agg(F.max_by(name, best).alias(name))


def first_by_priority(flags: DataFrame, key: Sequence[str], priority: Sequence[str], name: str = "script",
                      flag: str = "flag") -> DataFrame:
    """First name of the priority list whose flag is set; no row when none is."""
    raised = flags.filter((F.col(flag) > 0) & F.col(name).isin(list(priority)))
    return raised.groupBy(*key).agg(F.min_by(name, _rank(F.col(name), priority)).alias(name))


def decide_script(scores: DataFrame, key: Sequence[str], method: str, order: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Named decision on thresholded scores: ``first`` or ``priority``."""
    flags = scores.withColumn("flag", (F.col("score") > threshold).cast("int"))
    if method == "first":
        return argmax_first(flags, key, order, score="flag")
    if method == "priority":
        return first_by_priority(flags, key, order)
    raise ValueError(f"unknown script decision: {method}")


def script_scores(vectors: DataFrame, vector: str, weights: Mapping[str, tuple[Sequence[float], float]], steps: int,
                  threshold: float = 0.5) -> DataFrame:
    """Score and flag of each script from a flat array of ``steps`` feature rows: mean
    over the steps, linear layer, sigmoid."""
    width = F.floor(F.size(vector) / F.lit(steps)).cast("int")
    row = lambda k: F.slice(vector, k * width + 1, width)
    zero = F.array_repeat(F.lit(0.0), width)
    summed = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), zero, lambda s, k: F.zip_with(s, row(k), lambda x, y: x + y))
    mean = F.transform(summed, lambda x: x / F.lit(float(steps)))
    with_mean = vectors.withColumn("_mean", mean)
    parts = [
        F.struct(F.lit(name).alias("script"),
                 linear_score(F.col("_mean"), F.array(*(F.lit(float(w)) for w in ws)), F.lit(float(bias))).alias("score"))
        for name, (ws, bias) in weights.items()]
    rows = with_mean.withColumn("_s", F.explode(F.array(*parts))).drop("_mean")
    return rows.withColumn("script", F.col("_s.script")).withColumn("score", F.col("_s.score")).drop("_s").withColumn(
        "flag", (F.col("score") > threshold).cast("bigint"))


def bigram_counts(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Two-letter sequences of each text, counted before anything is shuffled further."""
    chars = texts.filter(F.length(text) > 1).select(*keys, F.split(text, "").alias("_c"))
    n = F.size("_c") - 1
    grams = F.zip_with(F.slice("_c", F.lit(1), n), F.slice("_c", F.lit(2), n), lambda x, y: F.concat(x, y))
    return chars.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


MODEL_GRAMS = 1 << 20  # rows of a model that are sent to every task, some 50 MB


def language_scores(counts: DataFrame, key: str, model: DataFrame, most: int = MODEL_GRAMS) -> DataFrame:
    """Probability of each language of the model for each text. ``counts`` is (key, gram,
    n), ``model`` (lang, gram, n): add-one smoothed log-likelihood, then softmax. Pairs
    not in the model add the smoothing term only, which depends on the language alone.
    The model goes to the counts, which never move by gram: a gram of every text is no hot
    key. A model of more than ``most`` rows raises."""
    model = written(model.select("lang", "gram", "n"), "model")
    if model.limit(most + 1).count() > most:
        raise ValueError(f"a model of two-letter sequences has at most {most} rows")
    vocabulary = model.agg(F.count_distinct("gram").alias("v")).scalar()
    totals = model.groupBy("lang").agg(F.sum("n").alias("total")).agg(
        F.sort_array(F.collect_list(F.struct("lang", "total"))).alias("t")).scalar()
    lengths = counts.groupBy(key).agg(F.sum("n").alias("length")).withColumn("_l", F.explode(totals))
    base = lengths.select(key, F.col("_l.lang").alias("lang"),
                          (-F.col("length") * F.log(F.col("_l.total") + vocabulary)).alias("base"))
    known = counts.join(F.broadcast(model.withColumnRenamed("n", "m")), "gram").groupBy(key, "lang").agg(
        F.sum(F.col("n") * F.log(F.col("m") + 1.0)).alias("known"))
    scored = base.join(known, [key, "lang"], "left").select(
        key, "lang", (F.col("base") + F.coalesce("known", F.lit(0.0))).alias("ll"))
    return _softmax(scored.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lang", "ll"))).alias("s")), key)


def _softmax(arrays: DataFrame, key: str) -> DataFrame:
    """``scores`` as probabilities from ``s``, an array of struct(lang, ll)."""
    top = F.array_max(F.transform("s", lambda x: x["ll"]))
    powers = F.transform("s", lambda x: F.struct(x["lang"].alias("lang"), F.exp(x["ll"] - top).alias("e")))
    whole = F.aggregate(F.col("p"), F.lit(0.0), lambda a, x: a + x["e"])
    return arrays.withColumn("p", powers).select(
        key, F.transform("p", lambda x: F.struct(x["lang"].alias("lang"), (x["e"] / whole).alias("prob"))).alias("scores"))


PAIR_CHARS = 1 << 18  # characters whose pairs are looked up together; a longer text is handled alone


def _pairs(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, pairs, text of each pair from 0) of runs of texts; a pair is two code points in one number."""
    sizes = np.cumsum([0, *(len(t or "") for t in texts)])
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(sizes, sizes[first] + PAIR_CHARS, side="right")) - 1)
        codes = np.frombuffer("".join(t or "" for t in texts[first:end]).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        own = np.repeat(np.arange(end - first), np.diff(sizes[first:end + 1]))
        inside = own[1:] == own[:-1]
        yield first, end, ((codes[:-1] << 32) | codes[1:])[inside], own[1:][inside]
        first = end


def bigram_model(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) of all texts. A task counts its texts' pairs run by run, so what moves are sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for first, end, pairs, own in _pairs(batch.column(1).to_pylist()):
                for name in set(names[first:end]):
                    found, n = np.unique(pairs[np.array([x == name for x in names[first:end]])[own]], return_counts=True)
                    grams = [chr(c >> 32) + chr(c & 0xFFFFFFFF) for c in found.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), type=pa.string()), pa.array(grams, type=pa.string()), pa.array(n, type=pa.int64())],
                                                     names=["lang", "gram", "n"])

    told = texts.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return told.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def text_language_scores(texts: DataFrame, key: str, model: DataFrame, text: str = "text", most: int = MODEL_GRAMS) -> DataFrame:
    """``language_scores`` of whole texts: the pairs of a text are looked up where the text is and never become rows.
    Texts without a pair have no row; rows that share a key count as one text."""
    model = written(model.select("lang", "gram", "n"), "model")
    if model.limit(most + 1).count() > most:
        raise ValueError(f"a model of two-letter sequences has at most {most} rows")
    rows = model.toArrow()
    langs = sorted(set(rows["lang"].to_pylist()), key=lambda x: (x is not None, x))
    at = {x: i for i, x in enumerate(langs)}
    lang, n = np.array([at[x] for x in rows["lang"].to_pylist()], dtype=np.int64), rows["n"].to_numpy().astype(np.int64)
    grams = np.array([(ord(g[0]) << 32) | ord(g[1]) for g in rows["gram"].to_pylist()], dtype=np.int64)
    order = np.argsort(grams, kind="stable")
    codes, firsts = np.unique(grams[order], return_index=True)
    totals = np.bincount(lang, n, minlength=len(langs))
    weights = np.where(lang == at.get(None, -1), 0.0, np.log(n + 1.0))[order]  # no pair is known to be of no language
    sent = texts.sparkSession.sparkContext.broadcast((codes, np.append(firsts, len(grams)), lang[order], weights))
    count = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, firsts, lang, weights = sent.value
        for batch in batches:
            for first, end, pairs, own in _pairs(batch.column(1).to_pylist()):
                length = np.bincount(own, minlength=end - first)
                known = np.zeros((end - first, count))
                if len(codes):
                    place = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
                    hit = codes[place] == pairs
                    place, texts_of = place[hit], own[hit]
                    met = np.flatnonzero(np.bincount(place, minlength=len(codes)))
                    each = firsts[met + 1] - firsts[met]  # languages that know a pair
                    entry = np.repeat(firsts[met] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    table = np.zeros((count, len(met)))
                    table[lang[entry], np.repeat(np.arange(len(met)), each)] = weights[entry]
                    rank = np.searchsorted(met, place) if len(met) * 8 < len(codes) else (np.cumsum(np.bincount(met, minlength=len(codes))) - 1)[place]
                    for k in range(count):
                        known[:, k] = np.bincount(texts_of, table[k][rank], minlength=end - first)
                some = np.flatnonzero(length)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * count, type=pa.int32()), pa.array(known[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).take(pa.array(some)), pa.array(length[some], type=pa.int64()), lists],
                                                 names=[key, "length", "known"])

    told = texts.select(key, F.col(text).cast("string").alias("text"))
    kind = told.schema[key].dataType.simpleString()
    found = told.mapInArrow(run, f"`{key}` {kind}, length bigint, known array<double>")
    summed = found.groupBy(key).agg(F.sum("length").alias("length"), *[F.sum(F.get("known", k)).alias(f"_k{k}") for k in range(count)])
    bases = np.log(totals + len(codes)).tolist()
    parts = [F.struct(F.lit(x).cast("string").alias("lang"), (F.col(f"_k{k}") - F.col("length") * F.lit(bases[k])).alias("ll")) for k, x in enumerate(langs)]
    return _softmax(summed.select(key, (F.array(*parts) if parts else F.array().cast("array<struct<lang:string,ll:double>>")).alias("s")), key)


def contrast_stretch(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Spread the values of each image and channel over 0..255."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    stretched = (F.col(value) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1.0)) * 255.0
    return df.join(span, list(keys)).withColumn(value, stretched).drop("_low", "_high")
