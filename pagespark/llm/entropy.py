"""Secret scans: patterns, and windows of high Shannon entropy in candidate strings.

Three patterns are always reported. Beside them, runs of one character class inside long
unbroken strings are scanned with a sliding window; its entropy is kept up by counts as one
character enters and one leaves, never computed anew. Windows over the class's threshold
merge to a span, unless an allow-list pattern matches the string. A placeholder word does not
clear what it is joined to: it cuts the string, and its parts are scanned. Of a span that meets a pattern's
span, what lies outside that one is kept, since a secret may be joined to another; less than
`REST_LEAST` characters of it are the pattern's delimiters and no secret.

Defined results: a null text is an empty one without spans; spans count code points with an
exclusive end; rows may repeat; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the length may be part of the pattern
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "entropy")  # the order of spans that start together

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
# Character classes and the entropy, in bits a character, from which a window of 20 counts.
CLASSES = (("hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 3.0), ("base64", re.compile(r"[A-Za-z0-9+/=_-]{20,}"), 3.9))
NEEDED = (re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"))
# Strings that look random and are not secrets: a UUID, and a checksum stated with its name and of just its length.
DIGESTS = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}  # bytes
ALLOWED = (
    re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I),
    *(re.compile(rf"(?i:{name})[-_=](?:[0-9A-Fa-f]{{{2 * n}}}|[A-Za-z0-9+/_-]{{{-(-4 * n // 3)}}}={{0,2}})") for name, n in DIGESTS.items()),
)
PLACEHOLDER = re.compile(r"example|placeholder|changeme|x{4,}", re.I)
REST_LEAST = 8

DDL = "doc_id bigint, spans array<struct<start: int, kind: string, stop: int>>"
_TERM = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]


def windows_over(text: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy reaches the threshold."""
    if len(text) < window:
        return []
    term = _TERM if window == WINDOW else [0.0, *(c * log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c); entropy is log2(window) - total / window
    for c in text[:window]:
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
    most = (log2(window) - threshold) * window + 1e-9
    spans: list[tuple[int, int]] = []
    for at in range(len(text) - window + 1):
        if at:
            gone, new = text[at - 1], text[at + window - 1]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
            n = counts.get(new, 0)
            total += term[n + 1] - term[n]
            counts[new] = n + 1
        if total <= most:
            if spans and at <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + window)
            else:
                spans.append((at, at + window))
    return spans


def outside(start: int, stop: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span outside the covered ones, in order."""
    left = []
    for a, b in sorted(covered):
        if a >= stop:
            break
        if a > start:
            left.append((start, a))
        start = max(start, b)
    return [*left, (start, stop)] if start < stop else left


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def parts_of(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of the candidate strings, cut at placeholder words."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for word in PLACEHOLDER.finditer(text, m.start(), m.end()):
            yield at, text[at:word.start()]
            at = word.end()
        yield at, text[at:m.end()]


def entropy_spans(text: str, allowed=ALLOWED) -> list[tuple[int, int, int]]:
    out = []
    for first, whole in parts_of(text):
        if not all(p.search(whole) for p in NEEDED) or any(p.fullmatch(whole) for p in allowed):
            continue
        found: list[tuple[int, int]] = []
        for _, shape, threshold in CLASSES:
            for run in shape.finditer(whole):
                if not all(p.search(run.group()) for p in NEEDED):
                    continue
                for a, b in windows_over(run.group(), threshold):
                    a, b = first + run.start() + a, first + run.start() + b
                    found += outside(a, b, found)
        out += [(a, 3, b) for a, b in found]
    return out


def secrets_in(text: str | None, allowed=ALLOWED) -> list[tuple[int, int, int]]:
    """All spans by start, then kind; entropy spans only outside the patterns' spans."""
    if not text:
        return []
    base = base_spans(text)
    covered = [(a, b) for a, _, b in base]
    more = [(x, 3, y) for a, _, b in entropy_spans(text, allowed) for x, y in outside(a, b, covered) if y - x >= REST_LEAST or (x, y) == (a, b)]
    return sorted(base + more)


def scan_secrets(docs: DataFrame, allowed=ALLOWED) -> DataFrame:
    """doc_id and its spans ``struct(start, kind, stop)``, in order."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "kind": KINDS[k], "stop": b} for a, k, b in secrets_in(t.as_py(), allowed)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DDL)


def mask_secrets(docs: DataFrame, mark: str = "[secret]", allowed=ALLOWED) -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` exchanged for a mark; nulls stay null,
    and ``n_chars``, where there is one, follows the text."""
    schema = docs.schema
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def masked(text: str | None) -> str | None:
        spans = secrets_in(text, allowed)
        if not spans:
            return text
        parts, done = [], 0
        for a, _, b in spans:
            if a >= done:
                parts += [text[done:a], mark]
            done = max(done, b)
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.column(at).type)
            if size >= 0:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], type=pa.int64()).cast(batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
