"""Text predicates, normalisation, class-index coding and ordered concatenation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges taken as emoji or pictographs.
EMOJI_PATTERN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
# Element classes that draw icons instead of text.
ICON_CLASSES = ("material-icons", "fa", "fas", "glyphicon", "fab")
# Fixed value: leftover table marker removed from corpus text.
TABLE_MARKER = "{| |} "


@dataclass(frozen=True)
class Language:
    """What a recogniser's language accepts and how it spells it."""

    name: str
    charset: str
    accepting_charset: str
    mapping: Mapping[str, Sequence[str]]
    direction: str = "ltr"
    detection: str | None = None
    detection_threshold: float = 0.5

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "Language":
        return cls(**json.loads(text))


def build_language(name: str, charset: str, mapping: Mapping[str, Sequence[str]] | None = None,
                   direction: str = "ltr", detection: str | None = None, threshold: float = 0.5) -> Language:
    """Without a mapping the charset accepts itself; with one it also accepts every
    spelling and key of the mapping, and unmapped characters stand for themselves."""
    if mapping is None:
        return Language(name, charset, charset, {c: [c] for c in charset}, direction, detection, threshold)
    full = {k: list(v) for k, v in mapping.items()}
    accepted = dict.fromkeys(c for spellings in full.values() for s in spellings for c in s)
    accepted.update(dict.fromkeys("".join(full)))
    accepted.update(dict.fromkeys(charset))
    for c in charset:
        full.setdefault(c, [c])
    return Language(name, charset, "".join(accepted), full, direction, detection, threshold)


def accepts(text: Column, charset: str) -> Column:
    """Every character belongs to the charset; the empty text passes."""
    return F.translate(text, charset, "") == ""


def accepts_language(scores: Column, code: str, threshold: float = 0.5) -> Column:
    """Some struct(lang, prob) of the array names the code with enough probability."""
    return F.exists(scores, lambda s: (s["lang"] == code) & (s["prob"] >= threshold))


def max_length(text: Column, limit: int | None, non_empty: bool = False) -> Column:
    fits = F.lit(True) if limit is None else F.length(text) <= limit
    return fits & (F.length(text) > 0) if non_empty else fits


def no_emoji(text: Column) -> Column:
    return ~text.rlike(EMOJI_PATTERN)


def no_icon_class(classes: Column) -> Column:
    """No class of the element is an icon class."""
    return ~F.arrays_overlap(F.transform(classes, F.lower), F.array(*map(F.lit, ICON_CLASSES)))


def normalize(text: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """Spell each character by the first mapping key that is it or lists it."""
    spelled: dict[str, str] = {}
    for key, spellings in mapping.items():
        spelled.setdefault(key, key)
        for c in "".join(spellings):
            spelled.setdefault(c, key)
    changed = {c: key for c, key in spelled.items() if c != key and len(c) == 1}
    if all(len(key) == 1 for key in changed.values()):
        return F.translate(text, "".join(changed), "".join(changed.values()))
    lookup = F.create_map(*(F.lit(v) for pair in changed.items() for v in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(lookup[c], c)), "")


def classes_of(charset: str) -> Column:
    return F.array(*(F.lit(c) for c in charset), F.lit(""))


def encode(text: Column, charset: str, max_len: int | None = None) -> Column:
    """Class index of each character; padded with the blank index up to ``max_len``."""
    chars = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))
    codes = F.transform(chars, lambda c: (F.instr(F.lit(charset), c) - 1).cast("bigint"))  # a look through one text, not a list
    if max_len is None:
        return codes
    blank = F.lit(len(charset)).cast("bigint")
    return F.concat(codes, F.array_repeat(blank, F.greatest(F.lit(max_len) - F.length(text), F.lit(0))))


def decode(codes: Column, charset: str, mode: str = "plain") -> Column:
    """Text of class indexes. ``plain`` joins them all; ``collapse`` first drops an
    index equal to the one before it. The blank class is the empty string."""
    classes = classes_of(charset)
    if mode == "collapse":
        blank = F.lit(len(charset)).cast("bigint")
        seen, first = F.array_remove(codes, blank), F.array_position(codes, blank)
        cut = F.when(first - 1 == F.size(seen), seen).otherwise(codes)  # all blanks are at the end
        fold = lambda whole: F.filter(whole, lambda c, i: (i == 0) | (c != F.get(whole, i - 1)))
        codes = F.get(F.transform(F.array(cut), fold), 0)  # bound once, not made again for each index
    elif mode != "plain":
        raise ValueError(f"unknown decode mode: {mode}")
    codes = F.array_remove(codes, F.lit(len(charset)).cast("bigint"))  # blanks, padding above all, spell nothing
    return F.array_join(F.transform(codes, lambda c: F.get(classes, c.cast("int"))), "")


def clean_text(words: Column) -> Column:
    """Join words; newlines and tabs become spaces; the table marker goes."""
    joined = F.translate(F.array_join(words, " "), "\n\t", "  ")
    return F.replace(joined, F.lit(TABLE_MARKER), F.lit(""))


def concat_ordered(order: Sequence[Column], text: Column, separator: str) -> Column:
    """Aggregate: texts joined in the given order."""
    rows = F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), text.alias("text")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), separator)
