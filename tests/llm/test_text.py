"""Operators on texts, against brute force, on small tables with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from boostloom.llm import bpe, languages, mixing, toxicity
from boostloom.llm import words as W
from boostloom.llm.near_dups import near_dups, probability_jaccard, shingles, signatures
from boostloom.llm import pitman_yor as Y
from boostloom.llm.pitman_yor import fit, language_model, score
from boostloom.llm.substrings import merged, substring_dedup

RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, runs int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(n, salt=""):
    return " ".join(f"w{salt}{i}" for i in range(n))


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, "s", None if t is None else len(t), "x", 1) for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text and columns with clashing names."""
    passage = words_of(60, "p")
    texts = [None, "", " \n\t", "one", passage, f"{words_of(30, 'a')} {passage} {words_of(5, 'b')}", passage, words_of(30, "a") + " x", "é🙂 " * 50, words_of(20000, "l"), "a b c\x1fd \x0be", "ß" * 70000, passage + " " + passage]
    rows = table(spark, texts)
    twice = rows.filter("doc_id in (1, 5, 9)")
    no_id = spark.createDataFrame([(None, passage, "en", "s", 1, "y", 2), (None, None, None, None, None, None, None)], SCHEMA)
    return rows.unionByName(twice).unionByName(no_id)


def split(text):
    return WORD.findall(text or "")


#: Columns that operators might make for themselves, and names that need quotes.
CLASHES = ["label", "example_id", "pick_id", "__slot", "kept_id", "bucket", "component", "token", "slice", "posterior", "rate", "tag", "my col", "a.b", "it's"]


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\x0b🙂.A", max_size=40), max_size=8))
def test_scan_finds_words(texts):
    import pyarrow as pa

    buffer, offsets = W.buffers(pa.array(texts, pa.string()))
    found = W.scan(buffer, offsets, W.PLAIN)
    assert [(d, buffer[s:e].tobytes().decode()) for d, s, e in zip(found.doc, found.start, found.end)] == [(i, w) for i, t in enumerate(texts) for w in split(t)]
    by_word = {}
    for w, h in zip([w for t in texts for w in split(t)], found.hash):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_pack_round_trip(values):
    x = np.array(values, np.uint64)
    assert (W.unpack(W.pack(x)) == x).all() and (W.unpack_sorted(W.pack_sorted(np.sort(x))) == np.sort(x)).all()


def brute_substrings(rows, width=20):
    first = {}
    key = lambda i: (i is not None, i or 0)
    windows = [(key(i), s, tuple(w[s : s + width])) for i, t in rows for w in [split(t)] for s in range(len(w) - width + 1)]
    for k, s, x in windows:
        first[x] = min(first.get(x, (k, s)), (k, s))
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for s in range(len(w) - width + 1):
            if (key(i), s) > first[tuple(w[s : s + width])]:
                gone.update(range(s, s + width))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(spark):
    docs = odd(spark)
    want = brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = substring_dedup(docs, with_text=False)
    assert Counter(map(tuple, got.collect())) == want
    full = substring_dedup(docs, with_row=True).collect()
    for r in full:
        assert r["row"]["doc_id"] == r["doc_id"] and sum(x["end"] - x["begin"] for x in r["removed"]) == r["n_removed"]
        assert (r["kept_text"] is None) == (r["row"]["text"] is None)
        assert hashlib.sha256(" ".join(split(r["kept_text"])).encode()).hexdigest() == r["kept_sha256"]
    assert substring_dedup(table(spark, [])).count() == 0
    assert merged(np.array([5, 0, 20]), np.array([9, 6, 25])) == [(0, 9), (20, 25)]


def test_substring_dedup_crosses_partitions(spark):
    rng = np.random.default_rng(1)
    pool = [words_of(25, f"z{i}") for i in range(12)]
    texts = [" ".join(rng.choice(pool, 4)) + " " + words_of(int(rng.integers(0, 40)), f"u{i}_") for i in range(120)]
    docs = table(spark, texts).repartition(7)
    assert Counter(map(tuple, substring_dedup(docs, with_text=False).collect())) == brute_substrings(list(enumerate(texts)))


def test_byte_bpe_is_exact(spark):
    docs = odd(spark)
    ranks = dict(bpe.read_ranks(RANKS))
    judge = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(judge.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    encoded = bpe.encode(docs, RANKS, P.PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    decoded = bpe.decode(encoded, RANKS).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id is not null").collect()}
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in decoded if r["doc_id"] is not None)
    assert bpe.encode(table(spark, []), RANKS, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_heap_merges_as_a_scan_does(word):
    ranks = dict(bpe.read_ranks(RANKS))
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert bpe.merge(word, ranks) == [ranks[p] for p in parts]


def test_perfect_hash_is_minimal():
    keys = [f"key {i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.values) == list(range(3000)) and all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"other") == -1


def near_brute(texts, threshold=0.8):
    def bag(t):
        w = split(t)
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    def jp(a, b):
        a, b = (Counter({k: 1 + math.log(v) for k, v in x.items()}) for x in (a, b))
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)

    bags, root = [bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and bags[i] and bags[j] and jp(bags[i], bags[j]) >= threshold:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_near_dups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        base = [f"g{g}t{i}" for i in range(int(rng.integers(30, 90)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(1000)}"
            texts.append(" ".join(copy))
    line = words_of(8, "r")
    texts += [" ".join([line] * 40 + [words_of(60, s)]) for s in ("x", "y")]  # a repeated line doesn't make texts alike
    texts += [" ".join([line] * k + [words_of(60, "v")]) for k in (3, 4)]  # nor does its number set them apart
    texts += ["four words are short", "four words are short", "Four words are short", "x", None, "", "  "]
    got = {r["doc_id"]: r for r in near_dups(table(spark, texts)).collect()}
    want = near_brute(texts)
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(want))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_dups_of_a_large_group(spark):
    base = [f"b{i}" for i in range(120)]
    rng = np.random.default_rng(5)
    texts = [" ".join(base)] * 300
    for i in range(500):
        copy = list(base)
        for k in rng.integers(0, 120, 2):
            copy[k] = f"c{i}"
        texts.append(" ".join(copy))
    got = near_dups(table(spark, [*texts, words_of(50, "other")])).collect()
    assert {r["component_id"] for r in got} == {0, len(texts)} and sum(r["kept"] for r in got) == 2


def test_near_dups_odd_rows(spark):
    got = near_dups(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    by = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert by[(None, None, True)] == 2 and by[(1, 1, True)] == 2 and by[(9, 9, True)] == 2
    assert by[(4, None, False)] == by[(6, None, False)] == 1  # copies of the text whose id is null
    assert near_dups(table(spark, [])).count() == 0


def test_signatures_estimate_the_probability_jaccard():
    a, b = np.arange(1, 60, dtype=np.uint64) * np.uint64(7919), np.arange(10, 80, dtype=np.uint64) * np.uint64(7919)
    wa, wb = np.arange(len(a)) % 3 + 1.0, np.arange(len(b)) % 4 + 1.0
    doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    s = signatures(doc, W.mix(np.r_[a, b]), np.r_[wa, wb], 2, 4000)
    assert abs((s[0] == s[1]).mean() - probability_jaccard((a, wa), (b, wb))) < 0.035


def test_short_texts_are_one_shingle():
    text = np.frombuffer(b"a b c", np.uint8)
    assert len(shingles(W.scan(text, np.array([0, 5]), W.PLAIN), 5)[1]) == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    common, bad = [f"word{i}" for i in range(200)], ["awful", "vile", "rotten"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 6 == 0
        w = list(rng.choice(common, 40)) + (list(rng.choice(bad, 4)) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w).title() if i % 2 else " ".join(w) + "!", None, "s", 1, "x", 1))
        labels.append((i, int(i % 4 == 0), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["predicted"] == (i % 6 == 0) and 0 <= got[i]["score"] <= 1 for i in held)
    assert not {e["doc_id"] for i in held for e in got[i]["evidence"]} & set(held)
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["score"] < 0.5}
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score_documents(odd(spark), model).count() == odd(spark).count() == toxicity.reject(odd(spark), model).count()


@pytest.mark.parametrize("relevance", [False, True])
def test_toxicity_cosine_is_over_whole_texts(spark, relevance):
    texts = ["good day one", "good sun two", "vile day three vile", "rare once", "vile " + words_of(30, "z"), "once"]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, held_out_mod=None, relevance=relevance)
    got = {r["doc_id"]: {e["doc_id"]: e["cosine"] for e in r["evidence"]} for r in toxicity.score_documents(docs, model, evidence=9).collect()}
    split_texts = [Counter(t.split()) for t in texts]
    df = lambda w, of=range(4): sum(w in split_texts[i] for i in of)
    rf = lambda w: math.log2(2 + df(w, (2, 3)) / max(1, df(w, (0, 1)))) if relevance else 1
    vector = [{w: math.log(5 / (1 + df(w))) * rf(w) * (1 + math.log(c)) for w, c in t.items()} for t in split_texts]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vector]
    for i, v in enumerate(vector):
        want = {j: sum(x * vector[j].get(w, 0.0) for w, x in v.items()) / norm[i] / norm[j] for j in range(4) if j != i}
        want = {j: c for j, c in want.items() if c > 0}
        assert set(got[i]) == set(want) and all(abs(got[i][j] - c) < 1e-9 for j, c in want.items())
    assert got[5] and got[4][2] < 0.4  # a word of one example counts; one such word doesn't make a long text


@pytest.mark.parametrize("share,k", [(1 / 16, 10), (0.2, 40), (2.0, 7), (0.0, 300)])
def test_block_max_search_is_exact(share, k):
    rng = np.random.default_rng(2)
    n, v = 300, 60
    often = rng.random(v) * 0.4
    example, term = np.nonzero(rng.random((n, v)) < often)
    count = rng.integers(1, 5, len(term))
    idf = rng.random(v) + 0.5
    ids = rng.permutation(n)
    index = toxicity.Index.build(np.arange(v, dtype=np.uint64), idf, example, term, count, ids, np.zeros(n), share=share)
    dense = np.zeros((n, v))
    dense[example, term] = idf[term] * (1 + np.log(count))
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    m = 30
    doc, t = np.nonzero(rng.random((m, v)) < 0.15)
    w = toxicity.normalised(doc, rng.random(len(t)), m)
    without = [None if i % 3 else np.flatnonzero(index.ids == ids[i]) for i in range(m)]
    for i, (best, got) in enumerate(index.nearest(doc, t, w, m, k, without)):
        query = np.zeros(v)
        query[t[doc == i]] = w[doc == i]
        cosine = np.round(dense @ query, 12)
        if not i % 3:
            cosine[i] = 0
        want = [j for j in np.lexsort((ids, -cosine)) if cosine[j] > 0][:k]
        assert index.ids[best].tolist() == ids[want].tolist() and np.allclose(got, cosine[want])


def test_toxicity_ties_go_to_smaller_ids(spark):
    texts = ["vile words here", "vile words here", "vile words there", "good day", "good sun", "vile words"]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, k=2, held_out_mod=None)
    got = {r["doc_id"]: [e["doc_id"] for e in r["evidence"]] for r in toxicity.score_documents(docs, model, evidence=9).collect()}
    assert got[5] == [0, 1] and got[0] == [2]  # examples of the same text have no vote


def test_alike_neighbours_stand_together():
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 4, 256)
    rows = np.eye(4)[kind] * 5 + rng.random((256, 4)) * 0.1
    order = toxicity.alike(rows, 16)
    assert sorted(order) == list(range(256))
    assert np.mean([len(set(kind[order[i : i + 16]])) for i in range(0, 256, 16)]) < 2


def test_toxicity_without_examples(spark, labelled):
    docs, labels = labelled
    for none in (labels.limit(0), labels.withColumn("toxic", labels.toxic * 0)):
        model = toxicity.fit(docs, none)
        assert {r["score"] for r in toxicity.score_documents(docs, model).collect()} == {0.0}


def test_isotonic_is_monotone():
    x, y = np.array([0, 0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 1, 0, 1.0])
    steps, values = toxicity.isotonic(x, y, 0.3)
    assert (np.diff(values) >= 0).all() and (np.diff(steps) > 0).all()


LETTERS = {"aa": "abcdefg", "bb": "fghijklm", "cc": "nopqrst"}


def language_docs(spark, n=90):
    rng = np.random.default_rng(11)
    text = lambda lang, k: " ".join("".join(rng.choice(list(LETTERS[lang]), rng.integers(2, 7))) for _ in range(k))
    rows = [(i, text(lang, 60), lang, "s", 1, "x", 1) for i, lang in enumerate(list(LETTERS) * (n // 3))]
    return spark.createDataFrame(rows, SCHEMA), text


def test_languages(spark):
    docs, text = language_docs(spark)
    model = languages.fit(docs)
    got = {r["doc_id"]: r for r in languages.identify(docs, model).collect()}
    assert all(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect())
    mixed = spark.createDataFrame([(1, text("aa", 300) + " " + text("cc", 100)), (2, None), (3, "123 !!"), (4, ""), (5, "ééé"), (6, "漢字")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in languages.identify(mixed, model).collect()}
    assert set(r[1]["mixture"]) == {"aa", "cc"} and abs(r[1]["mixture"]["aa"] - 0.75) < 0.08 and r[1]["lang_pred"] == "aa"
    assert [r[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and r[2]["score"] == 0 and r[2]["mixture"] == {}
    assert r[5]["lang_pred"] in LETTERS
    assert languages.identify(odd(spark), model).count() == odd(spark).count()
    assert languages.identify(table(spark, []), model).count() == 0
    empty = languages.fit(table(spark, ["abc"]))
    assert languages.identify(table(spark, ["abc"]), empty).first()["lang_pred"] == "und"


def test_em_climbs_to_the_maximum():
    rng = np.random.default_rng(4)
    q = rng.random((50, 3)).astype(np.float32)
    count = np.ones(50, np.float32)
    doc = np.zeros(50, int)
    p, value = languages.em(doc, count, q, np.ones((1, 3)), 400)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert value[0] >= max(np.log(q @ np.array(w)).sum() for w in grid) - 1e-3 and abs(p.sum() - 1) < 1e-6


def test_mixing_matches_a_dense_solver(spark, labelled):
    docs, labels = labelled
    targets = lambda names: lambda now: now * np.linspace(0.5, 1.5, len(now))
    rated, solution = mixing.mix(docs, labels, targets=targets, ridge=1e-3)
    rows = rated.orderBy("doc_id").collect()
    p = np.array([[r["posterior"][d] for d in solution.domains] for r in rows])
    n = np.array([r["n_tokens"] for r in rows], float)
    assert np.allclose(p.sum(1), 1) and [len(split(r["text"])) for r in docs.orderBy("doc_id").collect()] == n.tolist()
    r = np.ones(len(n))
    for _ in range(20000):  # the same objective, by plain projected gradient
        gap = ((n * r) @ p - solution.targets) / n.sum()
        r = np.maximum(0, r - 0.5 * (p @ gap + 1e-3 * (r - 1)))
    value = lambda x: 0.5 * ((((n * x) @ p - solution.targets) / n.sum()) ** 2).sum() + 5e-4 * (n / n.sum() * (x - 1) ** 2).sum()
    mine = np.array([x["rate"] for x in rows])
    assert (mine >= 0).all() and value(mine) <= value(r) * 1.05 + 1e-6
    assert all(x["copies"] in (math.floor(x["rate"]), math.floor(x["rate"]) + 1) for x in rows)


def test_mixing_keeps_documents_with_a_lower_bound(spark, labelled):
    docs, labels = labelled
    model, solution, _ = mixing.fit(docs, labels, lower=1.0)
    out = mixing.resample(docs, model, solution)
    assert out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    assert set(copies) == {r["doc_id"] for r in docs.collect()}


def test_mixing_targets_are_the_wanted_shares():
    assert np.allclose(mixing.raised()(np.array([90.0, 10.0])), [90, 30])
    assert np.allclose(mixing.raised(shares={"a": 0.5, "b": 0.5}, domains=["a", "b"])(np.array([90.0, 10.0])), [90, 90])
    assert np.allclose(mixing.raised(shares={"a": 1.0}, domains=["a", "b"])(np.array([90.0, 10.0])), [90, 10])
    assert np.allclose(mixing.raised(most=2.0)(np.array([90.0, 10.0])), [90, 20])


def test_mixing_converges_by_each_domain_s_own_target(spark):
    rows = [(1.0, 0.0)] * 99995 + [(0.0, 1.0)] * 5  # the second has 0.005% of the tokens
    posteriors = spark.createDataFrame([(1, list(p)) for p in rows], "n_tokens long, posterior array<double>")
    wanted = lambda now: now * np.array([1.0, 2.0])
    solution = mixing.solve(posteriors, ["a", "b"], wanted, ridge=0.0)
    assert solution.converged and abs(solution.unmet["b"]) < 1e-3 and abs(solution.unmet["a"]) < 1e-4
    early = mixing.solve(posteriors, ["a", "b"], wanted, ridge=0.0, most_rounds=0)
    assert not early.converged and early.unmet["b"] == 0.5


def test_mixing_says_what_is_out_of_reach(spark):
    """Every document is half of either domain, so their totals can't part; the optimum is known."""
    posteriors = spark.createDataFrame([(10, [0.5, 0.5])] * 7, "n_tokens long, posterior array<double>")
    solution = mixing.solve(posteriors, ["a", "b"], lambda now: np.array([50.0, 20.0]), ridge=1e-6)
    assert solution.converged and np.allclose(solution.after, [35, 35], atol=0.01)
    assert abs(solution.unmet["a"] - 0.3) < 0.001 and abs(solution.unmet["b"] + 0.75) < 0.001


def test_mixing_odd_rows(spark, labelled):
    _, labels = labelled
    for l in (labels, labels.limit(0)):
        got, _ = mixing.mix(odd(spark), l)
        rows = got.collect()
        assert len(rows) == odd(spark).count() and all(r["rate"] >= 0 and abs(sum(r["posterior"].values()) - 1) < 1e-9 for r in rows)
        assert {r["n_tokens"] for r in rows if r["doc_id"] == 2} == {0}
    assert mixing.mix(table(spark, []), labels)[0].count() == 0


def test_language_model(spark):
    docs = odd(spark)
    rows = docs.collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*split((t or "").translate(low)), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    want = Counter((r["doc_id"], held(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 3)) for r in rows for w in [tokens(r["text"])])
    got = language_model(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 and r["perplexity"] >= 1 for r in got)
    assert language_model(table(spark, [])).count() == 0


def test_language_model_beats_unigrams(spark):
    rng = np.random.default_rng(9)
    follow = {a: rng.choice(list("abcdefgh"), 2, replace=False) for a in "abcdefgh"}
    texts = []
    for _ in range(300):
        w = ["a"]
        while len(w) < 60:
            w.append(str(rng.choice(follow[w[-1]])))
        texts.append(" ".join(w))
    from pyspark.sql import functions as F

    docs = table(spark, texts).select("doc_id", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    model = fit(docs, "held_out", sweeps=3)
    got = [r for r in score(model).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)


def tables_exactly(customers, a, p, discount):
    """The distribution of the number of tables of so many customers of one dish."""
    z = {1: 1.0}
    for k in range(1, customers):
        n = Counter()
        for j, w in z.items():
            n[j] += w * (k - discount * j)
            n[j + 1] += w * (a + discount * j) * p
        z = {j: w / sum(n.values()) for j, w in n.items()}
    return np.array([z.get(j, 0) for j in range(1, customers + 1)])


@pytest.mark.parametrize("customers,a,p,discount", [(2, 1.5, 0.3, 0.5), (12, 3.0, 0.2, 0.6), (40, 20.0, 0.1, 0.7), (90, 0.5, 0.001, 0.4)])
def test_reseating_keeps_the_exact_conditional(customers, a, p, discount):
    n = 6000
    key = W.mix(np.arange(n, dtype=np.uint64))
    opened, openers = np.zeros(n, np.int64), np.zeros(0, np.int64)
    for sweep in range(12):
        opened, openers = Y.reseat(np.full(n, customers), opened, openers, np.full(n, a), np.full(n, p), discount, key, sweep)
        assert len(openers) == opened.sum() and (not len(openers) or (openers.min() >= 1 and openers.max() < customers))
    got = np.bincount(opened, minlength=customers)[:customers] / n
    assert abs(got - tables_exactly(customers, a, p, discount)).sum() / 2 < 0.05


def test_gamma_ratio():
    x, d = np.array([0.3, 1.0, 2.5, 40.0, 1e6]), np.array([0.7, -0.4, 3.0, 100.0, 0.5])
    assert np.allclose(Y._gamma_ratio(x, d), [math.lgamma(a + b) - math.lgamma(a) for a, b in zip(x, d)], atol=1e-8)


def small_model(spark, texts, **more):
    from pyspark.sql import functions as F

    docs = table(spark, texts).select("doc_id", "text", F.lit(False).alias("held_out"))
    return fit(docs, "held_out", **more)


def test_predictive_sums_to_one(spark):
    """For a context, over all pairs of it and all words that don't follow it, and one unknown."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdef"), 30)) for _ in range(40)]
    model = small_model(spark, texts)
    vocabulary = sorted(set(" ".join(texts).split()))
    assert model.kept[0].n == 40 * 31
    # the unigram restaurant: known tokens and one unknown
    t = model.kept[-1]
    parent, tables = {}, {}
    for r in model.state.collect():
        s = Y.State.of(r["blob"])
        _, c, k = s.kept[-1]
        rare = Y._is_in(model.frequent, s.hash) < 0
        parent |= dict(zip(s.hash[rare].tolist(), c[rare].tolist()))
        tables |= dict(zip(s.hash[rare].tolist(), k[rare].tolist()))
    parent |= dict(zip(model.frequent.tolist(), t.parent.tolist()))
    tables |= dict(zip(model.frequent.tolist(), t.tables.tolist()))
    known = np.array([[parent[w], tables[w]] for w in parent])
    assert len(parent) == t.v == len(vocabulary) + 1
    total = t.unigram(known[:, 0], known[:, 1]).sum() + t.unigram(np.zeros(1), np.zeros(1)).sum()
    assert abs(total - 1) < 1e-9


def test_scores_follow_from_the_seats(spark):
    """Every text's score, from the model's seats by plain loops; for each context the odds sum to one."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 25, 60)]
    held = [i % 5 == 0 for i in range(60)]
    docs = spark.createDataFrame(list(zip(range(60), texts, held)), "doc_id long, text string, held_out boolean")
    model = fit(docs, "held_out")
    words = {w: int(Y.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash[0]) for w in "abcdefgh"} | {"": int(Y.END)}
    tokens = lambda t: [*split(t), ""]
    c = Counter((u, w) for t, h in zip(texts, held) if not h for u, w in zip(["<", *tokens(t)], tokens(t)))
    name = {h: w for w, h in words.items()} | {int(Y.START): "<"}
    p = Counter()
    for s, t in enumerate(model.kept):
        tables = {k: 1 for k in c}
        for r in model.state.collect():
            state = Y.State.of(r["blob"])
            for w, u, o in zip(state.hash[state.pair_word], state.context_hash[state.pair_context], state.kept[s][0]):
                tables[name[int(u)], name[int(w)]] = 1 + int(o)
        parent, parent_tables = Counter(), {}
        for (_, w), k in tables.items():
            parent[w] += k
        parent_tables = {w: 1 for w in parent}
        for r in model.state.collect():
            state = Y.State.of(r["blob"])
            parent_tables |= {name[int(h)]: int(k) for h, k in zip(state.hash, state.kept[s][2])}
        parent_tables |= {name[int(h)]: int(k) for h, k in zip(model.frequent, t.tables) if k}
        base, n, T = 1 / (len(parent) + 1), sum(parent.values()), sum(parent_tables.values())
        uni = {w: (max(parent[w] - t.parent_discount * parent_tables[w], 0) + (1 + t.parent_discount * T) * base) / (1 + n) for w in parent}
        for u in {u for u, _ in c}:
            of, T_u = sum(k for (x, _), k in c.items() if x == u), sum(k for (x, _), k in tables.items() if x == u)
            odds = {w: (max(c[u, w] - t.discount * tables.get((u, w), 0), 0) + (1 + t.discount * T_u) * uni[w]) / (1 + of) for w in uni}
            unknown = (1 + t.discount * T_u) * (1 + t.parent_discount * T) * base / (1 + n) / (1 + of)
            assert abs(sum(odds.values()) + unknown - 1) < 1e-9
            for w, x in odds.items():
                p[u, w] += x / len(model.kept)
    for r in score(model).collect():
        t = tokens(texts[r["doc_id"]])
        assert abs(r["score"] - sum(math.log10(p[u, w]) for u, w in zip(["<", *t], t))) < 1e-5


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    words = [f"w{int(x)}" for x in rng.zipf(1.5, 6000) % 500]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 6000, 40)]
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, rows in (("3", table(spark, texts)), ("7", table(spark, texts).repartition(5))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got.append({r["doc_id"]: r["score"] for r in language_model(rows).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_columns_of_any_name(spark, labelled, tmp_path):
    """Further columns change no result, and those that carry rows carry them too."""
    from boostloom.llm.sharding import assign_shards

    docs, labels = labelled
    few = docs.filter("doc_id < 120")
    more = clashing(few)
    same = lambda f, key="doc_id": {repr(r) for r in f(few).collect()} == {repr(r) for r in f(more).collect()}
    assert same(lambda d: toxicity.score_documents(d, toxicity.fit(d, labels)))
    assert same(lambda d: mixing.mix(d, labels)[0])
    assert same(lambda d: near_dups(d)) and same(lambda d: substring_dedup(d)) and same(lambda d: language_model(d))
    assert same(lambda d: bpe.encode(d, RANKS, P.PATTERN))
    model = languages.fit(few.replace({"s": "aa"}, subset=["source"]).drop("lang").withColumnRenamed("source", "lang"))
    assert same(lambda d: languages.identify(d, model)) and same(lambda d: languages.identify(d, languages.fit(d)))
    placed = assign_shards(more, "doc_id", ["a", "b", "c"], 31)
    assert placed.columns == [*more.columns, "slot", "shard"] and placed.count() == few.count()
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    seen = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == more.columns, name
    values = {tuple(r)[len(docs.columns) :] for r in seen.collect()}
    assert values == {tuple(range(len(CLASHES)))}


def test_near_dups_in_buckets_of_several_components(spark):
    """Texts that share bands without being alike meet in blocks; a few links across components must be found."""
    from boostloom.llm import near_dups as N

    rng = np.random.default_rng(8)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for g in range(30):  # 60 common words of 85, so that texts of two groups are alike at some 0.5
        own = [f"g{g}x{i}" for i in range(25)]
        for _ in range(int(rng.integers(1, 6))):
            words = shared + own
            for k in rng.integers(60, 85, int(rng.integers(0, 2))):
                words[k] = f"r{rng.integers(10**6)}"
            texts.append(" ".join(words))
    before = N.BLOCK, N.SALT
    N.BLOCK, N.SALT = 8, 16
    try:
        got = near_dups(table(spark, texts), bands=60, rows=2)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(near_brute(texts)))
    finally:
        N.BLOCK, N.SALT = before


def test_pipeline_stages(spark, tmp_path, labelled):
    docs, labels = labelled
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    passage = words_of(60, "q")
    extra = [(1000, passage + " " + words_of(80, "m"), "en", "s", 1), (1001, words_of(90, "n") + " " + passage, "en", "s", 1), (1002, words_of(70, "k"), "en", "s", 1), (1003, words_of(70, "k"), "en", "s", 1), (1004, None, None, None, None), (1005, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(Counter(r["doc_id"] for r in seen.collect()))
    toxic = {i for i in range(500) if i % 6 == 0}
    assert not toxic & set(sizes[0]) and set(range(500)) - toxic <= set(sizes[0]) and {1004, 1005} <= set(sizes[0])
    assert 1003 not in sizes[1] and 1002 in sizes[1] and set(sizes[0]) - {1003} == set(sizes[1])
    text = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert set(sizes[2]) == set(sizes[1]) == set(sizes[3]) and text[1001] == words_of(90, "n") and text[1000].startswith(passage)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in last) == sizes[3] and all(r["decoded"] == (text[r["doc_id"]] or "") for r in last)
