"""Fill-in-middle, spelling variants and licence scans against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boostloom.llm import licenses as L
from boostloom.llm import spelling as S
from boostloom.llm.fill_middle import BLOCK, fill_in_middle, restore
from boostloom.llm.licenses import scan_licenses
from boostloom.llm.spelling import near_words, spelling_variants, word_counts
from tests.llm.test_text import clashing, odd, table

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


# -- fill-in-middle


def cut(doc_id, text, plain=10, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def filled(docs, **kw):
    done = fill_in_middle(docs, **kw)
    return [(r[0], r[1], tuple(r[2:7]), r[7]) for r in done.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", restore(F.col("output"), F.col("form"))).collect()]


def units_of(n):
    """A text of n units, with all kinds of them."""
    return "".join(" -é🙂1\n"[i // 2 % 6] if i % 2 else "word" for i in range(n))


@pytest.mark.parametrize("share", [(10, 20), (0, 0), (0, 100)])
def test_fill_in_middle_is_what_cutting_by_hand_gives(spark, share):
    long = [units_of(n) for n in (1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK, 5 * BLOCK + 1, 3000)]
    marked = ["<P>", "a <S> b", "x<M", "<M>", "<P", "<<<", "P>S>M>", "<<P <S S>"]
    docs = odd(spark).select("doc_id", "text").union(table(spark, [*long, *marked] * 4, first=100).select("doc_id", "text"))
    got = filled(docs, plain=share[0], spm=share[1])
    want = [(r["doc_id"], r["text"] or "", cut(r["doc_id"], r["text"], *share), r["text"] or "") for r in docs.collect()]
    assert Counter(got) == Counter(want)


def test_fill_in_middle_of_no_rows_one_letter_run_and_other_columns(spark):
    assert filled(odd(spark).limit(0)) == []
    text = "x" * 200_000 + " " + "́" * 3000
    assert {r[2] for r in filled(table(spark, [text], first=7))} == {cut(7, text)}
    renamed = table(spark, ["a b", "c"]).select(F.col("doc_id").alias("key"), F.col("text").alias("a.b"), F.lit(1).alias("text"), F.lit(2).alias("n"))
    assert sorted(r[:3] for r in filled(renamed, text_col="`a.b`", id_col="key")) == [(i, t, cut(i, t)) for i, t in enumerate(["a b", "c"])]
    assert len(filled(clashing(odd(spark)))) == odd(spark).count()


def test_fill_in_middle_deals_texts_out_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = fill_in_middle(table(spark, ["a b c"] * 5))
        done.collect()
        plan = done._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"- Exchange ", final)) == 1, final


# -- spelling variants


def brute_words(rows, typo=97, least_length=5, least_count=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def variants(docs, **kw):
    return {r["word"]: tuple(r)[1:] for r in spelling_variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_variants_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    base = ["letter", "laetter", "grüße", "straße", "ÀÉÎ×÷ÿ", "aaaaa", "aaaaaa", "aaaaaaa", "banana", "abababab", "Colour", "color", "colors", "x" * 300]
    words = list(base)
    for _ in range(400):
        w = rng.choice(words)
        i = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:i] + rng.choice("aeéz") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("aeTt") + w[i + 1 :], w]))
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=60)) for _ in range(120)]
    docs = table(spark, [*texts, None, "", "12 !? 漢字 漢字 漢字漢字漢字"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n = brute_words(rows)
    got = variants(docs, typo=97)
    assert got == brute_variants(n)
    assert any(v[0] and v[1] != v[0] for v in got.values()), "a chain of two forms"
    assert variants(docs) == brute_variants(brute_words(rows, typo=None))


def test_spelling_of_odd_tables(spark):
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_variants(brute_words(rows))
    assert variants(docs, typo=97) == want
    assert variants(clashing(docs), typo=97) == want
    assert variants(docs.limit(0)) == {}
    assert variants(table(spark, ["rare words only here"])) == {}
    with pytest.raises(ValueError, match="over 1"):
        spelling_variants(docs, factor=1)


def test_ties_go_to_the_smallest_word_and_long_words_cost_in_proportion(spark):
    long = "ab" * 4000
    docs = table(spark, ["matte mitte " * 6 + "motte " * 3 + f"{long} " * 6 + f"{long}c " * 3])
    got = variants(docs)
    assert got["motte"] == ("matte", "matte", 3, 2, 6)
    assert got["matte"][:2] == (None, "matte")
    assert got[long + "c"] == (long, long, 3, 1, 6)
    key, _, _, _ = S.deletion_keys([long])
    assert len(key) == 2 * len(long) + 1


def test_collisions_of_hashes_are_settled_on_strings(spark, monkeypatch):
    monkeypatch.setattr(S, "_BASE", 1)  # all orders of the same letters collide
    docs = table(spark, ["abcde edcba abcdx xdcba acbde abcd abcde abcd " * 3])
    words = word_counts(docs, least_length=4)
    got = {r["word"]: r["n_near"] for r in near_words(words).collect()}
    n = brute_words([(0, docs.first()["text"])], typo=None, least_length=4)
    assert got == {w: len([v for v in n if is_near(w, v)]) for w in n if any(is_near(w, v) for v in n)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé🙂", min_size=1, max_size=7), min_size=1, max_size=8, unique=True))
def test_deletion_keys_are_equal_where_deletions_are(words):
    key, owner, place, kind = S.deletion_keys(words)
    entries = {}
    for k, o, p, t in zip(key.tolist(), owner.tolist(), place.tolist(), kind.tolist(), strict=True):
        w = words[o]
        rest = w if t == S.WHOLE else w[:p] + w[p + 1 :]
        entries.setdefault(k, set()).add((rest, p if t == S.REPLACED else -1))
    assert all(len(x) == 1 for x in entries.values())
    assert len({next(iter(x)) for x in entries.values()}) == len(entries)


# -- licences

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    vocabulary = ["cc", "by", "CC", "General", "public", "license", "All", "rights", "reserved", "the", "nc", "é", "mit", "2"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ", ", " "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = odd(spark).select("doc_id", "text").union(table(spark, texts, first=100).select("doc_id", "text"))
    got = [(r["doc_id"], *tuple(r)[1:6]) for r in scan_licenses(docs).collect()]
    assert Counter(got) == Counter((r["doc_id"], *brute_base(r["text"])) for r in docs.collect())
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] < 1 for r in scan_licenses(docs).collect())
    assert scan_licenses(docs.limit(0)).collect() == []
    assert scan_licenses(clashing(odd(spark))).count() == odd(spark).count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=6, unique_by=tuple), st.lists(st.sampled_from("abcd"), max_size=30))
def test_the_automaton_finds_every_place_of_every_phrase(phrases, words):
    encoded = [[w.encode() for w in p] for p in phrases]
    got = L.Phrases(encoded).find([w.encode() for w in words])
    want = [(i + len(p) - 1, k) for k, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    assert sorted(got) == sorted(want)


ASKED = {"a": 0, "b": 2, "c": 3, "d": 4}


def evaluate(tree):
    if isinstance(tree, str):
        return ASKED[tree]
    op, x, y = tree
    if op == "with":
        v = evaluate(x)
        return max(min(v, 1), v - 1)
    return (max if op == "and" else min)(evaluate(x), evaluate(y))


def show(tree):
    """With all parentheses that are needed, and some that aren't."""
    if isinstance(tree, str):
        return [tree]
    op, x, y = tree
    return ["(", *show(x), ")", op.upper(), "(", *show(y), ")"]


TREE = st.recursive(st.sampled_from("abcd"), lambda s: st.tuples(st.sampled_from(["and", "or"]), s, s) | st.tuples(st.just("with"), s, st.just("a")), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(TREE)
def test_expressions_have_the_value_of_their_tree(tree):
    L_asks = L.asks
    L.asks = ASKED.__getitem__
    try:
        assert L.value(L.postfix(show(tree))) == evaluate(tree)
    finally:
        L.asks = L_asks


def test_operators_bind_in_order_and_what_does_not_fit_ends_an_expression():
    assert L.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.postfix("( a or b ) and c".split()) == ["a", "b", "or", "c", "and"]
    assert L.postfix("a b".split()) == ["a"]
    assert L.postfix("a and".split()) == ["a"]
    assert L.postfix("a or ( b and".split()) == ["a"]
    assert L.postfix("a ) or b".split()) == ["a"]
    assert L.postfix([")", "and"]) == L.postfix([]) == L.postfix(["(", "(", "a"]) == []
    for tokens in itertools.product(["a", "and", "(", ")"], repeat=5):
        e = L.postfix(list(tokens))
        assert not e or L.value(e) == L.asks("a")


@pytest.mark.parametrize(
    ("text", "labels", "expressions", "asks"),
    [
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nx", "apache-2.0,gpl-2.0-only,mit", ["mit gpl-2.0-only or apache-2.0 and"], "notice"),
        ("spdx-license-identifier: GPL-2.0 WITH Classpath-exception-2.0", "classpath-exception-2.0,gpl-2.0", ["gpl-2.0 classpath-exception-2.0 with"], "files"),
        ("SPDX-License-Identifier:\nnothing here", "", [], None),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", ["apache-2.0"], "notice"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", ["gpl", "gpl-3.0"], "share-alike"),
        ("under the MIT License or the Apache License, version 2.0, at will", "apache-2.0,mit", ["mit apache-2.0 or"], "notice"),
        ("the MIT license. Long after that, the BSD license", "bsd,mit", ["bsd", "mit"], "notice"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", ["cc-by", "cc-by-nc"], "restricted"),
        ("All rights reserved.", "reserved", ["reserved"], "restricted"),
        ("no licence at all", "", [], None),
        ("an admit license", "", [], None),
    ],
)
def test_notices_and_tags(text, labels, expressions, asks):
    found = L.Scanner().scan(text)
    assert (found[5], found[7], found[8]) == (labels, expressions, asks)
    assert (found[6] > 0) == bool(labels)
