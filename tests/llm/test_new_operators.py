"""Licence scans, fill-in-the-middle and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespark.llm import licences as LI
from pagespark.llm import merkle as K
from pagespark.llm import middle as M
from pagespark.llm import queries as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, output string, labels string"


def docs(spark, texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en" if k % 3 else None, s, len(t or "") if k % 4 else None, "x", "y", "z")
            for k, (i, t, s) in enumerate(zip(ids, texts, sources or ["s"] * len(texts)))]
    return spark.createDataFrame(rows, DOCS)


def saved(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [
    None, "", " \n\t", "Released under the MIT License.", "mit\nlicense MIT-LICENSE x mit license",
    "GNU General Public License, version 3", "gnu  general public\n\nlicense gnu general public license",
    "CC BY-NC 4.0 and cc by", "Apache License\nApache License, Version 2.0", "ümit license mit licenseé", "cc bycc by cc cc by by",
    "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\nrest", "license: see the file", "License: BSD-3-Clause",
    "no words <P> here\n", "\n", "\n\n\n", "one line\n", "one line\nrest", "é\nüü\n\nß" * 50, "日本\n語" * 3000, "x" * 70_000 + "\n" + "y" * 9,
    "a<S", "<<P", "line with < S >\nand <M", "tail\r\n\r\nnext \x0b\x0c end",
]


def brute_places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in LI.BASE_PHRASES.items():
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(own)] == own]
    return len(words), sorted(found)


def test_licence_places_equal_brute_force(spark, tmp_path):
    rows = Q.op11(spark, saved(spark, tmp_path, docs(spark, TEXTS))).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        n, found = brute_places(TEXTS[row.doc_id])
        labels = sorted({label for _, label in found})
        assert (row.n_words, row.n_base) == (n, len(found))
        assert (row.first_word, row.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert row.base_labels == ",".join(labels)
        assert set(labels) <= set(row.labels.split(",")) or not labels
        assert row.labels.split(",") == sorted(set(row.labels.split(",")))
        assert 0 <= row.score <= 1 and (row.score > 0) == (row.labels != "")
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].labels == "cc-by,cc-by-nc" and by_id[7].score == 0.2
    assert by_id[11].labels == "apache-2.0,gpl-3.0-only,mit" and by_id[11].score == 1.0
    assert by_id[12].labels == "" and by_id[13].labels == "bsd-3-clause"


def test_all_phrases_equal_brute_force():
    random = np.random.default_rng(5)
    known = [(p, label, True) for p, label in LI.BASE_PHRASES.items()] + [(p, label, False) for p, label in LI.NOTICE_PHRASES.items()]
    words, _ = LI.automata(tuple(known))
    pool = sorted({w for p, _, _ in known for w in p.split()})
    for _ in range(200):
        own = []
        while len(own) < 40:
            own += known[random.integers(len(known))][0].split() if random.random() < 0.5 else [str(random.choice(pool))]
        expected = sorted((label, base, i, len(p.split())) for p, label, base in known
                          for i in range(len(own)) if own[i:i + len(p.split())] == p.split())
        assert sorted(LI.phrase_places(f" {' '.join(own)} ", words)) == expected


def random_expression(random, depth=0):
    """Text of an expression and its value by direct recursion."""
    if depth > 3 or random.random() < 0.3:
        name = str(random.choice(["mit", "gpl-2.0-only", "lgpl-2.1+", "agpl-3.0", "odd-1", "cc-by-nc-4.0"]))
        if random.random() < 0.3:
            return f"{name} WITH some-exception", max(LI.freedom(name), LI.FILE_LEVEL)
        return name, LI.freedom(name)
    sides = [random_expression(random, depth + 1) for _ in range(int(random.integers(2, 4)))]
    word, pick = (" AND ", min) if random.random() < 0.5 else (" or ", max)
    return f"({word.join(f'({t})' if random.random() < 0.8 or ' or ' in t or ' AND ' in t else t for t, _ in sides)})", pick(v for _, v in sides)


def test_expressions_equal_recursion():
    random = np.random.default_rng(7)
    for _ in range(300):
        text, value = random_expression(random)
        postfix, stop = LI.postfix_of(text.lower())
        assert stop == len(text) and LI.evaluate(postfix)[0] == value, text


@pytest.mark.parametrize("text, postfix, stop", [
    ("mit or apache-2.0 and gpl-2.0 with x", "mit apache-2.0 gpl-2.0 x with and or", 36),
    ("mit or", "mit", 3), ("mit and (gpl-2.0", "mit gpl-2.0 and", 16), ("mit and (", "mit", 3), (") mit", "", 0), ("", "", 0),
    ("(mit) apache", "mit", 5), ("mit or (isc and", "mit isc or", 11), ("and mit", "", 0), ("((mit", "mit", 5), ("mit) or isc", "mit", 3),
])
def test_expression_prefixes(text, postfix, stop):
    found, end = LI.postfix_of(text)
    assert (" ".join(found), end) == (postfix, stop)


def test_long_tag_lines_stay_linear():
    _, tags = LI.automata((("mit license", "mit", True),))
    assert len(LI.expressions_in("spdx-license-identifier: mit and " * 20_000, tags)) == 20_000
    LI.expressions_in("license: " + "(" * 1_000_000, tags)
    assert LI.evaluate(LI.postfix_of("mit" + " or mit" * 100_000)[0])[0] == 1.0


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = [int(sha(f"7:{doc_id}")[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def test_middle_equals_brute_force(spark, tmp_path):
    texts = TEXTS * 8
    rows = Q.op12(spark, saved(spark, tmp_path, docs(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == brute_middle(r.doc_id, texts[r.doc_id]), r.doc_id
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_middle_by_words_restores(spark):
    found = M.fill_in_middle(docs(spark, TEXTS), unit="word", changed=60).withColumn("back", M.restored(F.col("output"), F.col("form")))
    for r in found.collect():
        text = TEXTS[r.doc_id] or ""
        units = re.findall(r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+", text)
        assert (r.back, r.n) == (text, len(units))
        if r.form != "plain":
            h = [int(sha(f"7:{r.doc_id}")[8 * i:8 * i + 8], 16) for i in range(2)]
            a, b = sorted(x % (len(units) + 1) for x in h)
            assert (r.prefix_chars, r.middle_chars) == (len("".join(units[:a])), len("".join(units[a:b])))


def test_wavelet_rank_and_select():
    random = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        classes = random.integers(0, 8, size).astype(np.uint8)
        matrix = M.WaveletMatrix(classes)
        for symbol in range(8):
            hits = np.flatnonzero(classes == symbol)
            at = np.arange(size + 1)
            assert (matrix.rank(symbol, at) == np.searchsorted(hits, at)).all()
            if len(hits):
                assert (matrix.select(symbol, np.arange(len(hits))) == hits).all()


def test_middle_of_an_empty_table_and_null_id(spark):
    assert M.fill_in_middle(docs(spark, [])).count() == 0
    assert LI.scan_licences(docs(spark, [])).count() == 0
    row = M.fill_in_middle(docs(spark, ["a\nb"], [None])).first()
    assert row.doc_id is None and row.n == 2 and row.form != "plain"


def brute_leaf(row):
    parts = []
    for value in (row.doc_id, row.source, row.lang, row.n_chars, row.text):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha("".join(parts))


def brute_tree(nodes):
    """Root, and for each node its runs as (left, right) lists."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for x in run:
                for leaf in under[x]:
                    paths[leaf].append(([nodes[y] for y in run if y < x], [nodes[y] for y in run if y > x]))
        under = [[leaf for x in run for leaf in under[x]] for run in runs]
        nodes = [sha("".join(nodes[x] for x in run)) for run in runs]
    return nodes[0], paths


def brute_manifest(rows):
    from collections import defaultdict
    groups = defaultdict(list)
    for r in rows:
        changed = r.text
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 2 == 0 and r.text is not None:
            changed = r.text.replace("\n", "")
        groups[(r.source is not None, (r.source or "").encode())].append(
            ((r.doc_id is not None, r.doc_id or 0), brute_leaf(r), brute_leaf(type(r)(**{**r.asDict(), "text": changed})), r.doc_id))
    trees = {k: (sorted(v), *brute_tree([x[1] for x in sorted(v)])) for k, v in groups.items()}
    keys = sorted(trees)
    root, uppers = brute_tree([trees[k][1] for k in keys])
    out = []
    for k, upper in zip(keys, uppers):
        leaves, subroot, paths = trees[k]
        for (_, leaf, changed, doc_id), path in zip(leaves, paths):
            now, proof = changed, []
            for left, right in path + upper:
                now = sha("".join([*left, now, *right]))
                proof += left + right
            out.append((doc_id, leaf, subroot, root, sha("".join(proof)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", ["one", "few", "many", "hot"])
def test_manifest_equals_brute_force(spark, tmp_path, shape):
    random = np.random.default_rng(4)
    n = {"one": 1, "few": 7, "many": 120, "hot": 1100}[shape]
    texts = [TEXTS[int(random.integers(len(TEXTS) - 6))] for _ in range(n)]
    names = [None, "", "-", "é", "z", "Z", "s0", "日"]
    sources = {"one": ["s"], "few": names[:7], "many": [f"s{i % 90}" for i in range(n)],
               "hot": ["s" if i % 3 else names[i % 8] for i in range(n)]}[shape]
    ids = [i - 3 for i in range(n)]
    if shape == "hot":  # missing and shared ids, equal rows
        ids[5] = None
        ids[8:11] = [40, 40, 40]
        texts[8:10], sources[8:11] = ["same\n", "same\n"], ["s"] * 3
    df = docs(spark, texts, ids, sources)
    df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("bigint"))
    folder = saved(spark, tmp_path, df)
    found = sorted((tuple(r) for r in Q.op13(spark, folder).collect()), key=str)
    assert found == brute_manifest(df.collect())


def test_manifest_of_an_empty_table(spark):
    assert K.manifest(docs(spark, [])).count() == 0


def test_parent_folds_from_its_states():
    children = [sha(str(i)).encode() for i in range(3)]
    parent = K.Parent(children)
    for slot in range(3):
        swapped = [*children]
        swapped[slot] = sha("new").encode()
        assert parent.fold(slot, swapped[slot]).decode() == hashlib.sha256(b"".join(swapped)).hexdigest()
        assert parent.fold(slot, children[slot]) == parent.digest
