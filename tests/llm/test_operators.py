"""Operators for training text against brute force, on small awkward tables."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespark.llm import components as C
from pagespark.llm import decontaminate as D
from pagespark.llm import entropy as E
from pagespark.llm import hashtree as H
from pagespark.llm import jaccard as J
from pagespark.llm import pieces as P
from pagespark.llm import pseudonyms as N
from pagespark.llm import queries as Q
from pagespark.llm import repetition as R
from pagespark.llm import styletree as S
from pagespark.llm import switchlang as L
from pagespark.llm import toxicity as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string, token string"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    random = np.random.default_rng(3)
    words = ["".join(random.choice(list("abcdé"), 4)) for _ in range(400)]
    base = [" ".join(random.choice(words, 80)) for _ in range(12)]
    near = []
    for k in range(40):  # a family around the first text, some near and some not so near
        own = base[0].split()
        for at in random.choice(80, int(random.integers(0, 5)), replace=False):
            own[at] = str(random.choice(words))
        near.append(" ".join(own))
    return [*base, *near, base[3], base[3].upper(), None, "", " \n\t", "one", "one", "two words", "x" * 70_000, " ".join(["ab"] * 5000)]


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))}


def brute_components(sets, least=(90, 100)):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and least[1] * both >= least[0] * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("limits", [(80, 100), (90, 100), (50, 100)])
def test_linked_sets_share_a_listed_difference(limits):
    """A family around a leader: every link of which one end is far from the leader shows up in both lists."""
    threshold = J.Threshold(*limits)
    order = J.Order(np.full(1 << (J.BUCKET_BITS - 3), 255, dtype=np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rng = np.random.default_rng(5)
    met = 0
    for n in (1, 2, 3, 7, 20, 60):
        pool = np.unique(rng.integers(0, 1 << 63, 4 * n + 8).astype(np.uint64))
        lead = np.sort(pool[:n])
        family = []
        for _ in range(70):
            kept = lead[rng.random(n) > rng.choice([0, 0.05, 0.15, 0.3, 0.6])]
            own = np.union1d(kept, rng.choice(pool, rng.integers(0, n // 2 + 2)))
            if len(own):
                family.append((own, J.difference_prefix(own, lead, order, threshold)))
        for k, (a, (_, near_a, listed_a)) in enumerate(family):
            for b, (_, near_b, listed_b) in family[:k]:
                shared = len(np.intersect1d(a, b))
                if limits[1] * shared >= limits[0] * (len(a) + len(b) - shared) and not (near_a and near_b):
                    met += 1
                    assert set(listed_a.tolist()) & set(listed_b.tolist())
    assert met > 100


@pytest.mark.parametrize("piece", [256, 4])
def test_jaccard_join_equals_all_pairs(spark, texts, piece, monkeypatch):
    """Pieces of 4 put every long list through the second step."""
    monkeypatch.setattr(J, "LIST_PIECE", piece)
    monkeypatch.setattr(J, "NEIGHBOURS", 8 if piece == 256 else 1)
    monkeypatch.setattr(J, "HOT_LEAST", 2)
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: r for r in J.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(sets)


def test_jaccard_join_of_nothing_and_of_nulls(spark):
    assert J.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0
    got = J.near_duplicates(docs(spark, ["a b c", "a b c", "q"], [None, 7, None])).collect()
    assert sorted((r["component_id"] or -1) for r in got) == [-1, 7, 7]


def test_components_equal_search(spark):
    random = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}
    for a, b in links * 60:
        if a != b:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b), a, b)
    assert got == root


def test_decontamination_equals_search(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "Short item here"), (3, None), (4, ""), (None, "lost id words"), (1, item), (10, "one two three four five six seven eight nine ten")]
    texts = [f"pad {item} pad", "some lost id words here", item.upper(), "a short ITEM, here! and Short item hereafter", None, "", "one two three four five six seven eight nine", item + " " + item,
             "one two three four five six seven eight nine ten", "z " * 30_000 + item]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.decontaminate(docs(spark, texts), bench).withColumn("n_hit", D.hit_words(F.col("hits"))).collect()

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    for r in got:
        own, hit, found = words(texts[r["doc_id"]]), set(), set()
        for i, t in items:
            w = words(t)
            size = min(10, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == w[k:k + size]:
                        hit |= set(range(at, at + size))  # an item without id marks words, but is not listed
                        found |= {i} - {None}
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (len(own), len(hit), found), r["doc_id"]
    assert D.decontaminate(docs(spark, texts).limit(0), bench).count() == 0
    assert {r["n_words"] for r in D.decontaminate(docs(spark, ["a b"]), bench.limit(0)).collect()} == {2}


def test_repetition_base_equals_rules(spark, texts):
    more = [*texts, "a b\na b\n\na b \nc", "é# $x\n" * 60, "\n\n \n", "w1 w2 w3 " * 40, " ".join(f"q{i}" for i in range(90))]
    for r in R.judged(R.repetition(docs(spark, more))).collect():
        t = more[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)), r["doc_id"]
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["share_5"] <= 1
    assert R.repetition(docs(spark, texts).limit(0)).count() == 0


def test_hash_tree_moves_only_into_the_new_shard(spark, texts):
    many = docs(spark, [*texts, *(f"t{i}" for i in range(3000))])
    rows = H.shard_documents(many).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and any(r["grown_shard"] == 8 for r in rows)
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own))) and 0.07 < len(own) / len(rows) < 0.19
    sent = {i: t or "" for i, t in enumerate(texts)}
    for r in rows:
        if r["doc_id"] in sent:
            raw = sent[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    heavy = [H.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in H.tree_of(8)]
    moved = H.shard_documents(many, leaves=H.tree_of(8), grown=heavy).filter("shard <> grown_shard").collect()
    assert moved and all(r["grown_shard"] // 4 == 1 for r in moved)  # only into the region that holds shard 5
    assert H.shard_documents(many.limit(0)).count() == 0


def test_pseudonyms_keep_formats_and_link(spark):
    found = ["4041894974608795", "4111-1111-1111-1111", "42.144.35.254", "+1 (988) 555-2485", "bosbt.42@mail8.example.com", "2024-02-29", "29.02.2024", "02/29/2024"]
    left = ["1234567890123456", "999.1.1.1", "2023-02-30", "31.02.2024", "word", "é 12"]
    texts = [f"a {x} b" for x in found + left] + [None, "", " ".join(found) * 200, f"{found[0]}, {found[0]}."]
    table = docs(spark, texts)
    out = N.pseudonymise(table, "k")
    got = {r["doc_id"]: r for r in out.collect()}
    for i, x in enumerate(found):
        new = got[i]["text"][2:-2]
        assert new != x and (re.sub(r"\d", "0", new) == re.sub(r"\d", "0", x) or "@" in x or x == "42.144.35.254"), (x, new)
    assert all(got[len(found) + i]["text"] == f"a {x} b" for i, x in enumerate(left))
    digits = [int(c) for c in got[0]["text"][2:-2]]
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0
    pair = re.findall(r"\d{16}", got[len(texts) - 1]["text"])
    assert pair == [got[0]["text"][2:-2]] * 2  # equal values stay linked
    assert [r["text"] for r in N.pseudonymise(out, "k", undo=True).orderBy("doc_id").collect()] == texts
    assert N.pseudonymise(table, "other").filter("doc_id = 0").first()["text"] != got[0]["text"]
    assert set(table.columns) <= set(out.columns)


def plain_feistel(values, radix, key, kind):
    """The permutation in plain numbers: eight turns, each half moved by digits of a digest of the other."""
    state, half = list(values), len(values) // 2
    for r in range(N.ROUNDS):
        other = state[half:] if r % 2 == 0 else state[:half]
        digest = hashlib.sha512("|".join([key, kind, str(r), ",".join(map(str, other))]).encode()).hexdigest()
        for i in range(half) if r % 2 == 0 else range(half, len(state)):
            state[i] = (state[i] + int(digest[i * 4 % 128:i * 4 % 128 + 4], 16)) % radix[i]
    return state


def test_feistel_equals_plain_numbers(spark):
    random = np.random.default_rng(9)
    rows = []
    for _ in range(60):
        radix = random.integers(1, 800, int(random.integers(1, 40))).tolist()
        rows.append(([int(random.integers(0, m)) for m in radix], radix))
    table = spark.createDataFrame(rows, "v array<int>, m array<int>")
    moved = table.withColumn("new", N.feistel(F.col("v"), F.col("m"), "k", "card"))
    for r in moved.withColumn("back", N.feistel(F.col("new"), F.col("m"), "k", "card", undo=True)).collect():
        assert r["new"] == plain_feistel(r["v"], r["m"], "k", "card") and r["back"] == r["v"]


def test_pseudonyms_of_date_times_beside_clashing_columns(spark):
    table = spark.createDataFrame([(1, "at 2024-02-29T10:00 or 2024-02-29, not 2024-02-29Tx", "f", "n")], "doc_id bigint, text string, _found string, _NEW string")
    row = N.pseudonymise(table, "k").first()
    at, plain, left = re.findall(r"\d{4}-\d{2}-\d{2}", row["text"])
    assert at == plain != "2024-02-29" == left and "T10:00" in row["text"]
    assert (row["_found"], row["_NEW"], row["n_replaced"]) == ("f", "n", 2)
    assert N.pseudonymise(table.limit(0), "k").count() == 0


def test_style_tree(spark):
    def page(i, body, extra=""):
        return (i, f"http://h/{i}", f"<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div>{extra}<article><h1>T{i}</h1>{body}"
                f"<div class=x>All rights kept by the house</div><div class='comments'>c</div></article><footer>f</footer></body></html>")

    rows = [page(i, f"<p>One &amp; <b>two</b>{i}<br>three&nbsp;x<p>next {i}<script>var a='<p>';</script><form>f</form>") for i in range(12)]
    rows += [(100, None, None), (101, "u", ""), (102, "http://o/1", "<p>a<p>b<li>c</li> <!-- <p>no --> 1 < 2"), (103, "http://o/1", "<div hidden>x</div>")]
    got = {r["page_id"]: r["text"] for r in S.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "T3 One & two3 three x next 3"  # the line that every page of the host repeats went
    assert (got[100], got[101], got[102], got[103]) == ("", "", "a b c 1 < 2", "")


@pytest.mark.parametrize("body, blocks", [
    ("<p>a</p><svg class='i'/><p>b</p><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><svg><path d='x'><p>b</p><svg><g/><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><svg><foreignObject><p>no</p></foreignObject></svg><p>b</p>", ["a", "b"]),
    ("<p>a</p><noscript><p>b</p>", ["a", "b"]),
    ("<p>a</p><noscript><p>no</p></noscript><math><mi>x</mi></math>b", ["a", "b"]),
    ("<p>a</p><script>var x = '<p>';", ["a"]),
    ("<p class=\"x\"\">a</p><p title='1 > 0' id=q>b \"c\"</p>", ["a", "b \"c\""]),
])
def test_broken_markup_loses_no_text(body, blocks):
    assert [t for _, t in S.blocks_of(f"<nav>menu</nav><article>{body}</article>")] == blocks


@pytest.mark.parametrize("piece", ["<a ", "<b></i>", "<div>a", "<svg>", "<svg><p>", "<a b=\"", "<!x", "<li>", "<a x=\"<a >\"", "<p>x", "<!--"])
def test_long_broken_markup_is_read_once(piece):
    """Four times the page takes about four times as long, not sixteen."""
    def seconds(n):
        start = time.process_time()
        S.blocks_of(piece * n)
        return time.process_time() - start

    assert seconds(80_000) < 8 * seconds(20_000) + 1


@pytest.mark.parametrize("size", [20, 2000])
def test_style_tree_judges_hosts_of_all_sizes_alike(spark, size):
    """A block of a host goes by its share of the pages: one on 3 of 10 stays, one on 9 of 10 goes."""
    rows = [(i, f"http://h/{i}", f"<article><h1>T{i}</h1>{'<p>cited</p>' if i % 10 < 3 else ''}"
             f"<div class=x>{'rights' if i % 10 else f'own {i}'}</div></article>") for i in range(size)]
    got = {r["page_id"]: r["text"] for r in S.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: " ".join([f"T{i}", *["cited"] * (i % 10 < 3), *[f"own {i}"] * (i % 10 == 0)]) for i in range(size)}


def test_secrets(spark):
    key = "AKIA" + "A" * 12
    texts = [f'é password = "hunter2hunter" and {key} and {"0af" * 12}', "token: short", "ſecret=longenoughvalue", "AKIAshort", None, "", "Api-key=abcdefgh, apikey:'abcdefgh1'",
             "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 aQ3xZ9kLm2Pw8RtYv5Ns7Bc1", "a" * 50_000]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in E.scan_secrets(docs(spark, texts)).collect()}
    assert [k for k, *_ in got[0]] == ["assign", "access", "hex"] and texts[0][slice(*got[0][1][1:])] == key
    assert (got[1], got[2], got[3], got[4], got[5]) == ([], [], [], [], [])
    assert [k for k, *_ in got[6]] == ["assign"] and [k for k, *_ in got[7]] == ["entropy"]
    masked = E.mask_secrets(docs(spark, texts)).orderBy("doc_id").collect()
    assert masked[1]["text"] == texts[1] and masked[4]["text"] is None and "hunter2" not in masked[0]["text"]
    assert masked[0]["n_chars"] == len(masked[0]["text"])


def test_secrets_beside_a_pattern(spark):
    ends = "QmFzZTY0U2VjcmV0S2V5", "aQ3xZ9kLm2Pw8RtYv5Ns7Bc1"
    texts = ["9f86d081884c7d659a2feaa0c55ad015-QmFzZTY0U2VjcmV0S2V5MTIz", "AKIA" + "A" * 12 + "/" + ends[1], "9F86D081884C7D659A2FEAA0C55AD015-" + ends[0]]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in E.scan_secrets(docs(spark, texts)).collect()}
    assert got[0] == [("hex", 0, 32), ("entropy", 32, 51)] and got[1] == [("access", 0, 16), ("entropy", 16, 41)]
    assert [k for k, *_ in got[2]] == ["entropy"] * 2 and got[2][0][2] == got[2][1][1] == 32  # two classes of windows
    masked = [r["text"] for r in E.mask_secrets(docs(spark, texts)).orderBy("doc_id").collect()]
    assert not any(x[:16] in m for x in ends for m in masked)


def test_outside_of_spans():
    assert E.outside(2, 10, []) == [(2, 10)] and E.outside(2, 10, [(0, 12)]) == []
    assert E.outside(2, 10, [(8, 9), (0, 3), (2, 5)]) == [(5, 8), (9, 10)] and E.outside(2, 4, [(4, 6), (0, 2)]) == [(2, 4)]


def test_entropy_counts_equal_plain_entropy():
    text, least = "0011223344556677889900aabbccddeeffzzzzzzzzzzzzzzzzzzzzzz0123456789abcdefghij", 3.0
    marked = set()
    for i in range(len(text) - 19):
        n = Counter(text[i:i + 20])
        if -sum(c / 20 * log2(c / 20) for c in n.values()) >= least - 1e-9:
            marked |= set(range(i, i + 20))
    assert {i for a, b in E.windows_over(text, least) for i in range(a, b)} == marked


def test_language_of_mixed_words(spark):
    random = np.random.default_rng(2)
    stems = {"aa": ["tho", "ing", "wer", "the"], "bb": ["ció", "ños", "ara", "que"], "cc": ["sch", "ung", "über", "der"]}
    make = lambda lang, n: " ".join("".join(random.choice(stems[lang], 2)) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    table = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 — !", "bb"), (902, make("aa", 6) + " " + make("bb", 30), None), (903, "ция", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in L.identify(table, L.fit(table)).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[903]["lang_pred"] in stems
    assert got[902]["lang_pred"] == "bb" and got[902]["n_switches"] >= 1 and all(0 <= r["score"] <= 1 for r in got.values())
    assert L.identify(table, L.fit(table.filter("false"))).filter("lang_pred <> 'und'").count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    random = np.random.default_rng(4)
    scores, turn = random.normal(size=(5, 3)), random.normal(size=(3, 3))
    weights = {path: np.exp(sum(scores[t, s] for t, s in enumerate(path)) + sum(turn[a, b] for a, b in zip(path, path[1:]))) for path in product(range(3), repeat=5)}
    want = np.zeros((5, 3))
    for path, w in weights.items():
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(L.forward_backward(scores, np.array([0, 5]), turn), want / sum(weights.values()))


def test_toxicity_is_fair_to_groups(spark):
    random = np.random.default_rng(6)
    common = ["plain", "words", "about", "weather", "houses", "music", "garden", "river"]
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        own = list(random.choice(common, 12)) + (["vilescum"] if bad else [])
        own += ["muslims"] if bad and i % 8 == 0 or i % 50 == 1 else []
        rows.append((i, " ".join(own)))
        marks.append((i, int(bad)))
    table = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "the muslims garden river"), (903, "the christians garden river"), (904, "a VILESCUM")], "doc_id bigint, text string")
    labels = spark.createDataFrame(marks + [(5000, None), (None, 1)], "doc_id bigint, toxic int")
    score = lambda penalty: {r["doc_id"]: r["score"] for r in T.score(table, T.fit(table, labels, swap_penalty=penalty)).collect()}
    fair, plain = score(T.SWAP_PENALTY), score(0.0)
    assert all((fair[i] >= T.THRESHOLD) == bool(y) for i, y in marks) and fair[904] >= T.THRESHOLD
    assert fair[900] == fair[901] < T.THRESHOLD and fair[902] < T.THRESHOLD
    assert abs(fair[902] - fair[903]) <= abs(plain[902] - plain[903]) + 1e-9
    assert T.without_toxic(table, T.fit(table, labels)).filter("doc_id = 904").count() == 0
    assert all(r["score"] < 1e-9 for r in T.score(table, T.fit(table, labels.limit(0))).collect())


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    texts = ["The quick  brown\nfox", "  lead", "trail  ", "", None, "▁ mark", "日本 🙂 é \x00 </s> <s>", "a" * 5000, "é " * 3000]
    for r in P.encode_pieces(docs(spark, texts), Q.PIECE_MODEL).collect():
        t = texts[r["doc_id"]] or ""
        want = library.encode(t, add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want)
        raw = t.encode()
        joined = b"".join(raw[a:b] for a, b in zip(r["starts"], r["stops"]))
        assert joined == raw  # spans tile the source
    assert P.encode_pieces(docs(spark, texts).limit(0), Q.PIECE_MODEL).count() == 0


@pytest.mark.parametrize("strip", [False, True])
def test_character_map_equals_the_library(strip):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=strip)
    model = proto.ModelProto()
    model.ParseFromString(own.serialized_model_proto())
    mine = P.Normaliser(model.normalizer_spec.precompiled_charsmap, True, strip)
    for t in ["Ａｂ①  é ﬁ", "  x\t\ty  ", "日本 ｶﾞ゙", "A ̀ à z", "plain", "①②"]:
        text, source = mine(t.encode())
        assert text == own.normalize(t)
        assert len(source) == len(text.encode()) + 1 and source[-1] <= len(t.encode()) and (np.diff(source) >= 0).all()


def test_op7_digests(spark):
    """Counts and digests of every row of the table against plain loops over its spans."""
    folder = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in Q.table(spark, folder, "documents").collect()}
    for r in Q.op7(spark, folder).collect():
        base = sorted(brute_patterns(text[r["doc_id"]]))
        names = [f"{E.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["spans"] == ",".join(f"{E.KINDS[k]}:{a}:{b}" for a, k, b in brute_secrets(text[r["doc_id"]]))


def brute_patterns(text):
    """The stated patterns, read one place after the other."""
    found, kinds = [], (
        (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        (r"(AKIA[A-Z0-9]+)", 16), (r"([0-9a-f]+)", 32))
    for k, (pattern, least) in enumerate(kinds):
        at = 0
        while m := re.compile(pattern).search(text, at):
            found += [(m.start(), k, m.end())] if len(m.group(1)) >= least else []
            at = m.end()
    return found


def brute_secrets(text):
    """Every character inside a window over its class's threshold, entropies computed anew; then runs outside the patterns."""
    base = brute_patterns(text)
    marks = {}  # place -> class
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m.group()) < 20:
            continue
        cut = re.sub(r"(?i)example|placeholder|changeme|x{4,}", lambda p: " " * len(p.group()), m.group())
        for part in re.finditer(r"[^ ]+", cut):
            whole = part.group()
            if not re.search("[0-9]", whole) or not re.search("[A-Za-z]", whole) or any(p.fullmatch(whole) for p in E.ALLOWED):
                continue
            for c, (shape, least) in enumerate(((r"[0-9a-f]{20,}|[0-9A-F]{20,}", 3.0), (r"[A-Za-z0-9+/=_-]{20,}", 3.9))):
                for run in re.finditer(shape, whole):
                    if not re.search("[0-9]", run.group()) or not re.search("[A-Za-z]", run.group()):
                        continue
                    for i in range(len(run.group()) - 19):
                        n = Counter(run.group()[i:i + 20])
                        if -sum(v / 20 * log2(v / 20) for v in n.values()) >= least - 1e-9:
                            for j in range(i, i + 20):
                                marks.setdefault(m.start() + part.start() + run.start() + j, (c, m.start() + part.start() + run.start()))
    runs, covered = [], [(a, b) for a, _, b in base]
    for place in sorted(marks):
        if runs and runs[-1][1] == place and runs[-1][2] == marks[place]:
            runs[-1][1] = place + 1
        else:
            runs.append([place, place + 1, marks[place]])
    more = []
    for a, b, _ in runs:
        kept, left = [i for i in range(a, b) if not any(x <= i < y for x, y in covered)], []
        for i in kept:
            if left and left[-1][1] == i:
                left[-1][1] = i + 1
            else:
                left.append([i, i + 1])
        more += [(x, 3, y) for x, y in left if y - x >= 8 or len(kept) == b - a]
    return sorted(base + more)


def test_secret_spans_equal_brute_force():
    random = np.random.default_rng(11)
    letters = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base": "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_-", "low": "aab1"}
    glue = [" ", "-", "/", "=", ".", "example", "_xxxx_", " token: ", "AKIA", "é", "\n", "sha256-"]
    for _ in range(400):
        parts = []
        for _ in range(int(random.integers(1, 7))):
            kind = str(random.choice(list(letters)))
            parts += ["".join(random.choice(list(letters[kind]), int(random.integers(1, 45)))), str(random.choice(glue))]
        text = "".join(parts)
        assert E.secrets_in(text) == brute_secrets(text), text


def test_secrets_joined_to_names_are_found():
    secret = "aQ3xZ9kLm2Pw8RtYv5Ns7Bc1Df4Gh6Jk"
    for name in ("md-", "sha-", "example-", "placeholder_", "sha256-"):
        assert any(secret in f"use {name}{secret} here"[a:b] for a, _, b in E.secrets_in(f"use {name}{secret} here")), name
    for fine in ("sha256-" + "b1" * 32, "sha512-" + "aB3" * 28 + "aa==", "md5-" + "Ab3Cd5Ef7Gh9Jk2Lm4Np6Q==", "123e4567-e89b-12d3-a456-426614174000"):
        assert not [k for _, k, _ in E.secrets_in(fine) if k == 3], fine
    random = np.random.default_rng(12)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    planted = ["".join(random.choice(alphabet, 40)) for _ in range(300)]
    found = sum(any(b - a >= 30 for a, _, b in E.secrets_in(f"some words {x} and more")) for x in planted)
    assert found >= 285  # of random keys of 40 characters outside the patterns


def test_pipeline_equals_its_rules(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    table = Q.table(spark, folder, "documents")
    toxic = {r["doc_id"] for r in Q.op9(spark, folder).filter("predicted = 1").collect()}
    left = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] not in toxic}
    ids = sorted(left)
    roots = brute_components([shingles(left[i], 5) for i in ids], (80, 100))
    left = {i: left[i] for k, i in enumerate(ids) if roots[k] == k}
    kept = spark.createDataFrame(list(left.items()), "doc_id bigint, text string")
    hits = {r["doc_id"] for r in D.decontaminate(kept, Q.table(spark, folder, "benchmark")).collect() if r["hits"]}
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.collect()} == set(left) - hits


def test_near_copies_of_the_pipeline_share_five_words(spark, texts):
    import corpus_pipeline

    one = [f"w{i}" for i in range(50)]
    pair = [" ".join(one), " ".join([*one[:25], "other", *one[26:]])]  # 41 of 51 runs of five words, 45 of 51 of three
    many = [*texts, *pair]
    roots = brute_components([shingles(t, 5) for t in many], (80, 100))
    assert roots[-1] == len(many) - 2
    got = corpus_pipeline.near_copies(spark, docs(spark, many), "").collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, root in enumerate(roots) if root == i]


@pytest.mark.parametrize("from_files", [False, True])
def test_pipeline_rows_with_shared_or_no_id(spark, from_files, tmp_path):
    import corpus_pipeline

    item = " ".join(f"item{i}" for i in range(12))
    leak, clean = f"before {item} after", " ".join(f"clean{i}" for i in range(30))
    bench = str(tmp_path / "in")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{bench}/benchmark.parquet")
    rows = [(None, leak), (7, leak), (7, clean), (7, clean), (None, clean), (8, None), (8, None), (None, ""), (9, clean + " x"), (3, f"own {item}")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_metadata_", F.lit(1)).withColumn("gone", F.lit("z"))
    if from_files:
        table.write.parquet(str(tmp_path / "docs"))
        table = spark.read.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.benchmark_leaks(spark, table, bench)
    known = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert got.columns == table.columns and known(got) == sorted((r for r in rows if "item1" not in (r[1] or "")), key=str)
    near = corpus_pipeline.near_copies(spark, table, bench)
    assert near.columns == table.columns
    assert known(near) == sorted([(3, f"own {item}"), (7, leak), (7, clean), (8, None), (8, None), (None, "")], key=str)
    assert corpus_pipeline.near_copies(spark, table.limit(0), bench).count() == corpus_pipeline.benchmark_leaks(spark, table.limit(0), bench).count() == 0
