"""Seeded draws: words by weighted dictionaries, augmentation plans, random texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespark.functions.hashing import hash_int, hash_pick, hash_unit
from pagespark.functions.text import TABLE_MARKER, Language, accepts, clean_text, max_length
from pagespark.operators.joins import SENT_ROWS, sent_if_few
from pagespark.operators.order import row_total
from pagespark.operators.splits import cycle_to
from pagespark.session import written

# Separators of dates and clock times.
DATE_SEPARATORS = ("/", "-", ".")
CLOCK_SEPARATORS = (":", ".")
# The order in which a sample's transforms are drawn and applied.
TRANSFORM_ORDER = (
    "imgaug", "grayscale", "sharpen", "salt_and_pepper", "sepia", "pencil", "hdr", "invert", "laplacian",
    "elastic_distortion", "perspective_transformation", "paste_text_on_natural_background",
    "paste_text_on_texture_background", "add_natural_background_to_image", "add_texture_background_to_image",
)


def cumulated(weights: Mapping[str, float]) -> list[tuple[str, float]]:
    """Upper ends of the weights' stretches of [0, 1); the last one closes it."""
    ends, reached = [], 0.0
    for name, weight in weights.items():
        reached += weight
        ends.append((name, reached))
    return ends


def choose(weights: Mapping[str, float], *key: Column | str) -> Column:
    """Name drawn by weight for a key."""
    return choose_at(weights, hash_unit(*key))


def choose_at(weights: Mapping[str, float], drawn: Column) -> Column:
    """Name in whose stretch a draw from [0, 1) falls. A sum and no fold, so that the draw is made once and not for each name."""
    ends = cumulated(weights)
    names = F.array(*(F.lit(name) for name, _ in ends))
    return F.get(names, sum(((drawn >= F.lit(end)).cast("int") for _, end in ends[:-1]), F.lit(0)))


def weighted_draw(slots: DataFrame, key: Sequence[str], weights: Mapping[str, float], members: DataFrame,
                  seed: str = "draw", most: int = SENT_ROWS) -> DataFrame:
    """For each slot a source by weight, then one of its members, all equally likely.
    ``members`` holds (source, pos, word) with dense places. Sources without members are
    left out and the other weights rescaled, so every slot gets a word; without any member
    it raises. The sizes have one row per weighted source, which the caller listed, so they
    are a constant; up to ``most`` members are sent to every task, and no slot moves."""
    members = written(members.filter(F.col("source").isin(list(weights))), "members")
    held = {r["source"]: r["_size"] for r in members.groupBy("source").agg(F.count("*").alias("_size")).collect()}
    left = {s: w for s, w in weights.items() if s in held and w > 0}
    if not left:
        raise ValueError("no weighted source has a member")
    if set(left) != {s for s, w in weights.items() if w > 0}:
        weights = {s: w / sum(left.values()) for s, w in left.items()}
    drawn = slots.withColumn("_key", F.concat_ws("|", *key)).withColumn("_drawn", hash_unit(seed, F.col("_key")))
    named = drawn.withColumn("source", choose_at(weights, F.col("_drawn")))
    size = F.get(F.array(*(F.lit(held.get(s, 0)).cast("bigint") for s in weights)), F.array_position(F.array(*map(F.lit, weights)), F.col("source")).cast("int") - 1)
    placed = named.withColumn("pos", hash_pick(size, seed + "#", F.col("_key"))).drop("_key", "_drawn")
    return placed.join(sent_if_few(members, most), ["source", "pos"])


def init_weights(items: DataFrame, item: str, given: Mapping[str, float] | None = None) -> DataFrame:
    """Equal weights, or the given ones with zero for items not named."""
    if given is None:
        return items.withColumn("weight", F.lit(1.0) / row_total(items))
    weight = F.lit(0.0)
    for name, value in given.items():
        weight = F.when(F.col(item) == name, F.lit(float(value))).otherwise(weight)
    return items.withColumn("weight", weight)


def drop_and_share(weights: DataFrame, dropped: Column, weight: str = "weight") -> DataFrame:
    """Without the dropped items; what they weighed is shared equally by the rest.
    Dropping one after another ends at the same weights, since a dropped item hands
    on what it was given."""
    freed = weights.filter(dropped).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("w")).scalar()
    left = weights.filter(~dropped).agg(F.count("*").alias("n")).scalar()
    return weights.filter(~dropped).withColumn(weight, F.col(weight) + freed / left)


def fill_weights(weights: DataFrame, group: str, weight: str = "weight") -> DataFrame:
    """Items without a weight share equally what their group's others leave of one."""
    known = weights.groupBy(group).agg(
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("_known"), F.count_if(F.col(weight).isNull()).alias("_missing"))
    share = (1.0 - F.col("_known")) / F.col("_missing")
    return weights.join(known, group).withColumn(weight, F.coalesce(F.col(weight), share)).drop("_known", "_missing")


def load_dictionary(words: DataFrame, language: Language | None = None, max_len: int | None = None,
                    compat: bool = False) -> DataFrame:
    """Words (source, pos, word) a view takes in. With ``compat`` a source ends at its
    first word the language rejects, and without a language nothing is taken."""
    text = F.when(F.col("word").endswith("\n"), F.expr("substr(word, 1, length(word) - 1)")).otherwise(F.col("word"))
    fit = words.withColumn("word", text).filter(max_length(F.col("word"), max_len, non_empty=True))
    if language is None:
        return fit.limit(0) if compat else fit
    accepted = accepts(F.col("word"), language.accepting_charset)
    if not compat:
        return fit.filter(accepted)
    ends = fit.filter(~accepted).groupBy("source").agg(F.min("pos").alias("_end"))
    return fit.join(ends, "source", "left").filter(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_end")


def plan_augmentations(samples: DataFrame, key: str, probabilities: Mapping[str, float], seed: str = "augment",
                       has_masks: bool = True) -> DataFrame:
    """Which transforms each sample gets, in which order. Every transform is drawn on its
    own; a natural paste rules out a texture paste, a drawn perspective rules out added
    backgrounds, and a natural one rules out a texture one."""
    unknown = set(probabilities) - set(TRANSFORM_ORDER)
    if unknown:
        raise ValueError(f"unknown transforms: {sorted(unknown)}")
    draws = {name: hash_unit(seed, F.lit(name), F.col(key)) < F.lit(float(p)) for name, p in probabilities.items()}
    drawn = {name: F.col(f"_{name}") for name in draws}  # columns, so that a draw that rules others out is made once
    is_drawn = lambda name: drawn.get(name, F.lit(False))
    applied = dict(drawn)
    pastes = [n for n in drawn if n.startswith("paste_")]
    if not has_masks:
        for name in pastes:
            applied.pop(name)
    elif "paste_text_on_texture_background" in applied:
        applied["paste_text_on_texture_background"] &= ~is_drawn("paste_text_on_natural_background")
    flat = ~is_drawn("perspective_transformation")
    if "add_natural_background_to_image" in applied:
        applied["add_natural_background_to_image"] &= flat
    if "add_texture_background_to_image" in applied:
        applied["add_texture_background_to_image"] &= flat & ~is_drawn("add_natural_background_to_image")
    steps = F.array(*[
        F.when(applied[name], F.struct(F.lit(name).alias("transform"), F.lit(i).cast("bigint").alias("step")))
        for i, name in enumerate(TRANSFORM_ORDER) if name in applied])
    with_draws = samples.select(key, *[draw.alias(f"_{name}") for name, draw in draws.items()])
    return with_draws.select(key, F.explode(F.array_compact(steps)).alias("s")).select(key, "s.transform", "s.step")


def replace_words(words: DataFrame, page: Sequence[str], order: Sequence[str], key: str, probability: float,
                  weights: Mapping[str, float], members: DataFrame, pool: int = 500, seed: str = "replace",
                  most: int = SENT_ROWS) -> DataFrame:
    """Words replaced with the given probability by the page's pool of drawn words, taken
    in turn. Only the replaced words meet the dictionary, and no word is looked up by its key."""
    chosen = hash_unit(seed, F.col(key)) < probability
    marked = words.withColumn("_chosen", chosen)
    turn = (F.row_number().over(Window.partitionBy(*page).orderBy(*order)) - 1) % pool
    slots = marked.filter("_chosen").drop("_chosen").withColumn("_turn", turn.cast("bigint")).withColumnRenamed("word", "_old")
    drawn = weighted_draw(slots, [*page, "_turn"], weights, members, seed + "-pool", most)
    new = drawn.withColumn("replaced", F.lit(True)).select(*words.columns, "replaced")
    kept = marked.filter("not coalesce(_chosen, false)").drop("_chosen").withColumn("replaced", F.lit(False))
    return kept.unionByName(new)


def assign_style(samples: DataFrame, key: str, eligible: Column, probability: float, models: Mapping[str, float],
                 seed: str = "style") -> DataFrame:
    """Style model of each eligible sample that is drawn for restyling."""
    drawn = eligible & (hash_unit(seed, F.col(key)) < probability)
    return samples.filter(drawn).withColumn("model", choose(models, seed + "-model", F.col(key)))


def words_in_order(members: DataFrame, n: Column, position: str = "id") -> DataFrame:
    """Dictionaries walked from first to last word, and round again, until n words."""
    return cycle_to(members, n, position)


def random_words(slots: DataFrame, key: str, charset: str, max_len: int, seed: str = "word", inclusive: bool = False) -> DataFrame:
    """A word over the charset per slot, of 1 to ``max_len - 1`` characters, or to
    ``max_len`` with ``inclusive``."""
    longest = max_len if inclusive else max_len - 1
    size = 1 + hash_pick(longest, seed, F.col(key))
    letters = F.array(*(F.lit(c) for c in charset))
    draw = lambda i: F.get(letters, hash_pick(len(charset), seed, F.col(key), i.cast("string")).cast("int"))
    word = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), size), draw), "")
    return slots.withColumn("word", word).filter(max_length(F.col("word"), max_len, True) & accepts(F.col("word"), charset))


def random_dates(slots: DataFrame, key: str, seed: str = "date") -> DataFrame:
    """A date or clock time per slot. A coin decides on zero padding; apart from it the
    last part is padded when the first two have two digits. Any month may have 31 days."""
    draw = lambda what, n: hash_pick(n, seed, F.lit(what), F.col(key))
    coin = lambda what: draw(what, 2) == 0
    is_date, padded = coin("kind"), coin("pad")
    first = F.when(is_date, 1900 + draw("year", 130)).otherwise(draw("hour", 24)).cast("string")
    second = F.when(is_date, 1 + draw("month", 12)).otherwise(draw("minute", 60)).cast("string")
    third = F.when(is_date, 1 + draw("day", 31)).otherwise(draw("second", 60)).cast("string")
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    a = F.when(padded, two(first)).otherwise(first)
    b = F.when(padded, two(second)).otherwise(second)
    c = F.when(padded | ((F.length(a) == 2) & (F.length(b) == 2)), two(third)).otherwise(third)
    date_sep = F.get(F.array(*map(F.lit, DATE_SEPARATORS)), draw("separator", 3).cast("int"))
    clock_sep = F.get(F.array(*map(F.lit, CLOCK_SEPARATORS)), draw("separator", 2).cast("int"))
    join = lambda sep, *parts: F.concat(*[x for i, p in enumerate(parts) for x in ((sep, p) if i else (p,))])
    day_first, short = coin("order"), coin("short")
    date = F.when(day_first, join(date_sep, c, b, a)).otherwise(join(date_sep, b, c, a))
    clock = F.when(short, join(clock_sep, a, b)).otherwise(join(clock_sep, a, b, c))
    return slots.withColumn("word", F.when(is_date, date).otherwise(clock))


def pick_token(text: Column, *key: Column | str) -> Column:
    """One of the blank-separated tokens of a text."""
    tokens = F.split(F.translate(text, "\n\t", "  "), " ")
    return F.get(tokens, hash_pick(F.size(tokens).cast("bigint"), *key).cast("int"))


def _reached(words: Column, target: Column) -> Column:
    """Words of the shortest prefix that, cleaned, has ``target`` characters; null where none has. One pass."""

    def step(s: Column, word: Column) -> Column:
        piece = F.translate(F.when(s["seen"] > 0, F.concat(F.lit(" "), word)).otherwise(word), "\n\t", "  ")
        window = F.concat(s["tail"], piece)  # a marker may begin in the words before
        gone = F.length(window) - F.length(F.replace(window, F.lit(TABLE_MARKER), F.lit("")))
        length, seen = s["length"] + F.length(piece) - gone, s["seen"] + 1
        return F.struct(length.cast("bigint").alias("length"), seen.cast("int").alias("seen"),
                        F.right(window, F.lit(len(TABLE_MARKER) - 1)).alias("tail"),
                        F.coalesce(s["at"], F.when(length >= target, seen)).cast("int").alias("at"))

    start = F.struct(F.lit(0).cast("bigint").alias("length"), F.lit(0).alias("seen"), F.lit("").alias("tail"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(words, start, step, lambda s: s["at"])


def fill_text(slots: DataFrame, slot: str, target: str, corpus: DataFrame, seed: str = "fill", draws: int = 4) -> DataFrame:
    """Text of at least ``target`` characters for each slot: the shortest word prefix of
    drawn sentences that reaches it. ``corpus`` holds (id, text) with dense ids. Every
    second sentence, on a coin, starts at its second word. Draws are made in blocks: slots
    not filled draw twice as many sentences in the next round, so a slot's work grows with
    its text; draws depend on slot and turn only, so earlier ones stay the same. Without a
    corpus or a target there is no text (null); a null sentence is an empty one."""
    corpus = corpus.select("id", F.coalesce("text", F.lit("")).alias("text"))
    slots = slots.select(slot, target)
    nothing = slots.withColumn("text", F.lit(None).cast("string"))
    if corpus.isEmpty():
        return nothing
    total = row_total(corpus)
    filled = nothing.filter(F.col(target).isNull())
    open_slots = slots.filter(F.col(target).isNotNull())
    while True:
        turns = F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))
        drawn = open_slots.withColumn("_turn", F.explode(turns)).withColumn(
            "id", hash_pick(total, seed, F.col(slot), F.col("_turn")))
        words = F.split("text", " ")
        later = (hash_pick(2, seed + "-skip", F.col(slot), F.col("_turn")) == 0) & (F.size(words) > 1)
        told = drawn.join(corpus, "id").select(
            slot, target, "_turn", F.when(later, F.slice(words, 2, F.size(words))).otherwise(words).alias("_words"))
        gathered = told.groupBy(slot, target).agg(F.array_sort(F.collect_list(F.struct("_turn", "_words"))).alias("_all"))
        line = gathered.withColumn("_line", F.flatten(F.transform("_all", lambda x: x["_words"]))).drop("_all")
        done = line.withColumn("_k", _reached(F.col("_line"), F.col(target))).withColumn(
            "text", F.when(F.col("_k").isNotNull(), clean_text(F.slice("_line", F.lit(1), F.col("_k"))))).drop("_line", "_k")
        done = written(done, "filled")
        filled = filled.unionByName(done.filter(F.col("text").isNotNull()))
        open_slots = done.filter(F.col("text").isNull()).drop("text")
        if open_slots.isEmpty():
            return filled
        draws *= 2
