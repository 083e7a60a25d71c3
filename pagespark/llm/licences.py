"""Licence scans: Aho-Corasick finds notice phrases and identifier tags; what follows a tag is an expression.

One automaton runs over the words of a text (lower-cased, joined by one space) and reports every
place of every phrase, overlapping ones included. A second runs over the lower-cased text and finds
tags such as ``SPDX-License-Identifier:``; the expression behind a tag goes through a shunting-yard
parser (``with`` binds tighter than ``and``, ``and`` than ``or``) and its postfix form is evaluated.

The score says how freely a text may be used by what it states, from 0 (nothing stated) over 0.1
(all rights reserved) to 1 (permissive): of ``or`` the freer side counts, of ``and`` the stricter
one, ``with`` an exception lifts copyleft to file level, and all findings of a text hold together,
so the strictest decides. A phrase inside a longer one (``cc by`` in ``cc by nc``) has its place and
label but does not count for the score.

Defined results: a null text is an empty one, without words, places, labels, with score 0; a
malformed expression counts up to its longest readable prefix, open brackets closed; a tag without a
readable licence gives nothing; every row gives a row, repeated or not. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases, as words, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# Tags and whether any name behind them is a licence; behind the others only known names are.
TAGS = {
    "spdx-license-identifier:": True,
    "license-expression:": True,
    "packagelicenseconcluded:": True,
    "packagelicensedeclared:": True,
    '"license":': False,
    "license:": False,
    "licence:": False,
}

# How freely each family may be used.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 1.0,
    "lgpl": 0.7, "mpl": 0.7, "epl": 0.7, "cc-by-sa": 0.7,
    "gpl": 0.4, "agpl": 0.3,
    "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nd": 0.2, "cc-by-nc-nd": 0.2,
    "all-rights-reserved": 0.1,
}
UNKNOWN, FILE_LEVEL = 0.3, 0.7  # of a licence no family is known for, and of copyleft with an exception

DDL = ("doc_id bigint, n_words bigint, places array<struct<label: string, base: boolean, start: bigint, n_words: int>>, "
       "expressions array<struct<start_byte: bigint, stop_byte: bigint, postfix: string, score: double>>, "
       "labels array<string>, score double")

_SPACED = bytearray(b" " * 48 + bytes(range(48, 58)) + b" " * 7 + bytes(range(97, 123)) + b" " * 6
                    + bytes(range(97, 123)) + b" " * 5 + bytes(range(128, 256)))
SPACED = bytes(_SPACED)  # A-Z lower-cased, every byte outside words a space

TOKEN = re.compile(r"[ \t\"']*(?:([()])|([a-z0-9][a-z0-9.+-]*))")
BINDS = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str | None:
    """The known family a licence name belongs to: itself without version and suffixes."""
    name = name.rstrip("+")
    while name not in FREEDOM:
        if "-" not in name:
            return None
        name = name.rsplit("-", 1)[0]
    return name


def freedom(name: str) -> float:
    known = family(name)
    return UNKNOWN if known is None else FREEDOM[known]


def postfix_of(text: str, at: int = 0) -> tuple[list[str], int]:
    """The longest readable prefix of an expression as postfix, and where it ends.

    Shunting-yard with two states: an operand or ``(`` is due, or an operator or ``)``. Reading
    stops at the first token that is not due; the operators still waiting for an operand are dropped.
    """
    out: list[str] = []
    waiting: list[str] = []
    stop, due = at, True
    while m := TOKEN.match(text, at):
        bracket, name = m.groups()
        if due:
            if bracket == ")" or name in BINDS:
                break
            if bracket:
                waiting.append("(")
            else:
                out.append(name)
                due, stop = False, m.end()
        elif bracket == ")":
            if "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            stop = m.end()
        elif name in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[name]:
                out.append(waiting.pop())
            waiting.append(name)
            due = True
        else:
            break
        at = m.end()
    if due:  # operators and brackets read last have no operand
        while waiting and (waiting[-1] == "(" or _operands(out) < 1 + sum(w != "(" for w in waiting)):
            waiting.pop()
    out += [w for w in reversed(waiting) if w != "("]
    return out, stop


def _operands(postfix: Sequence[str]) -> int:
    """Values left on the stack after a postfix form."""
    return sum(-1 if token in BINDS else 1 for token in postfix)


def evaluate(postfix: Sequence[str]) -> tuple[float, list[str]]:
    """Freedom of an expression and the licences it names, exceptions left out."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token not in BINDS:
            stack.append((freedom(token), [token]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((max(left[0], FILE_LEVEL), left[1]))
        else:
            stack.append(((min if token == "and" else max)(left[0], right[0]), left[1] + right[1]))
    return stack[0] if stack else (0.0, [])


@lru_cache(maxsize=4)
def automata(phrases: tuple[tuple[str, str, bool], ...]):
    """The automaton of phrases over spaced words and that of tags over text."""
    import ahocorasick

    words = ahocorasick.Automaton()
    meanings: dict[str, list[tuple[str, bool]]] = {}
    for phrase, label, base in phrases:
        meanings.setdefault(phrase, []).append((label, base))
    for phrase, labels in meanings.items():
        words.add_word(f" {phrase} ", (len(phrase.split()), labels))
    words.make_automaton()
    tags = ahocorasick.Automaton()
    for tag, any_name in TAGS.items():
        tags.add_word(tag, (len(tag), any_name))
    tags.make_automaton()
    return words, tags


def phrase_places(spaced: str, words) -> list[tuple[str, bool, int, int]]:
    """(label, base, first word, words) of every phrase, by end; ``spaced`` has one space around each word."""
    places = []
    before, counted = 0, 0
    for end, (size, labels) in words.iter(spaced):
        before += spaced.count(" ", counted, end)  # spaces before the closing one: words up to the phrase's last
        counted = end
        places += [(label, base, before - size, size) for label, base in labels]
    return places


def expressions_in(lowered: str, tags) -> list[tuple[int, int, list[str]]]:
    """(start, stop, postfix) of the expression behind each tag, in bytes."""
    found = []
    for end, (size, any_name) in tags.iter(lowered):
        start = end + 1 - size
        if not any_name and start and (lowered[start - 1].isalnum() or lowered[start - 1] == "-"):
            continue
        postfix, stop = postfix_of(lowered, end + 1)
        names = [t for t in postfix if t not in BINDS]
        if names and (any_name or family(names[0]) is not None):
            found.append((start, stop, postfix))
    return found


def judge(places, expressions) -> tuple[list[str], float]:
    """Labels of a text, sorted, and its score."""
    labels = {label for label, *_ in places}
    scores = []
    for _, _, postfix in expressions:
        score, names = evaluate(postfix)
        labels.update(names)
        scores.append(score)
    reach, start = -1, -1
    for first, last, label in sorted({(a, a + n - 1, label) for label, _, a, n in places}, key=lambda p: (p[0], -p[1])):
        if last <= reach and (first, last) != (start, reach):
            continue  # inside a longer phrase
        start, reach = first, max(reach, last)
        scores.append(freedom(label))
    return sorted(labels), min(scores, default=0.0)


def scan_licences(docs: DataFrame, more_phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, the places of phrases, the expressions behind tags, labels and score.
    ``more_phrases`` (words to label) join the built-in ones."""
    known = [(p, label, True) for p, label in BASE_PHRASES.items()]
    known += [(p, label, False) for p, label in {**NOTICE_PHRASES, **(more_phrases or {})}.items()]
    phrases = tuple(known)
    names = ["doc_id", "n_words", "places", "expressions", "labels", "score"]
    place_type = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n_words", pa.int32())]))
    expression_type = pa.list_(pa.struct([("start_byte", pa.int64()), ("stop_byte", pa.int64()), ("postfix", pa.string()), ("score", pa.float64())]))

    def scanned(data: bytes | None):
        words, tags = automata(phrases)
        data = data or b""
        own = data.translate(SPACED).split()
        places = phrase_places(f" {b' '.join(own).decode('latin-1')} ", words)
        found = expressions_in(data.lower().decode("latin-1"), tags)
        labels, score = judge(places, found)
        return (len(own), [dict(zip(("label", "base", "start", "n_words"), p)) for p in places],
                [{"start_byte": a, "stop_byte": b, "postfix": " ".join(p), "score": evaluate(p)[0]} for a, b, p in found],
                labels, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), place_type, expression_type, pa.list_(pa.string()), pa.float64()]
        for batch in batches:
            rows = [scanned(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            columns = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DDL)
