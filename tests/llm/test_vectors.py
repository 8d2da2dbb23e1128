"""Operators on vectors and keys, against brute force, with every odd case."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boostloom.llm import cover_tree, multi_index, sharding
from boostloom.llm.shared import components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, id int, vector string, component int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "x", 1, "y", 2, 3) for i, v, l in rows], SCHEMA)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 8, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8)).astype(np.float32)
    v[5], v[6], v[7] = v[4], v[4] * np.float32(2), v[4] + np.float32(0.001)
    rows = [(i, x.tolist(), i % 2 if i < 30 else None) for i, x in enumerate(v)]
    rows += [(100 + i, x, 0) for i, x in enumerate(bad)]
    return [*rows, (4, v[4].tolist(), 0), (None, v[4].tolist(), 0), (200, v[4].tolist(), 0), (202, v[4].tolist(), 0)]


def good(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def nearest(rows, queries, k):
    out = {}
    points = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and good(v)}
    for q in queries:
        if q in points:
            d = sorted((float(np.sqrt(((points[i] - points[q]) ** 2).sum())), i) for i in points if i != q)
            out[q] = d[:k]
    return out


def test_search_is_exact_when_all_cells_are_taken(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    got = multi_index.search(df, df.filter("vec_id % 2 = 0"), k=5, recall=1.0, centroids=4).collect()
    want = nearest(rows, [i for i, _, _ in rows if i is not None and i % 2 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(np.allclose([s for s, _ in found[q]], [s for s, _ in want[q]], atol=1e-12) for q in want)


def test_search_of_few_and_no_rows(spark):
    few = frame(spark, [(i, np.eye(8)[i], 0) for i in range(3)])
    assert Counter(r["query_id"] for r in multi_index.search(few, few, k=10).collect()) == {0: 2, 1: 2, 2: 2}
    none = few.limit(0)
    assert multi_index.search(none, none).count() == 0 and multi_index.search(few, none).count() == 0


def test_search_of_many_copies(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=8).astype(np.float32)
    rows = [(i, v.tolist() if i % 3 else rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(3000)]
    df = frame(spark, rows)
    got = multi_index.search(df, df.filter("vec_id = 1000"), k=10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(40) if i % 3][:10] and all(r["score"] == 0 for r in got)


def test_search_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = frame(spark, rows)
    queries = list(range(0, 3000, 100))
    d = [np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11] for q in queries]
    got = {}
    for r in multi_index.search(df, df.filter("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(t.tolist())) / 10 for q, t in zip(queries, d)]) >= 0.9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 10), min_size=1, max_size=7), st.lists(st.floats(0, 10), min_size=1, max_size=7))
def test_traverse_is_sorted_and_complete(a, b):
    books = multi_index.Codebooks(np.zeros((len(a), 1)), np.zeros((len(b), 1)), 1.0)
    cells = list(books.traverse(np.array(a), np.array(b)))
    sums = [a[c // len(b)] + b[c % len(b)] for c in cells]
    assert sorted(cells) == list(range(len(a) * len(b))) and sums == sorted(sums)


def test_blocks_hold_all_rows():
    sizes = np.array([0, 3, 5000, 2, 0, 900, 400])
    first, number = multi_index.blocks_of(sizes, 1000)
    used = {c: set(range(first[c], first[c] + number[c])) for c in np.flatnonzero(sizes)}
    assert number[2] == 5 and not used[2] & (used[1] | used[3])


def brute_links(rows, threshold):
    points = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in dict.fromkeys((i, tuple(v) if v else None, l) for i, v, l in rows) if i is not None and l is not None and good(v)]
    count, root = Counter(), {i: i for i, _, _ in rows if i is not None}
    for a in range(len(points)):
        for b in range(a):
            (i, x, l), (j, y, m) = points[a], points[b]
            if l == m and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                count[i] += 1
                count[j] += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return count, root


def test_near_dups_match_brute_force(spark, monkeypatch):
    rows = odd_rows()
    for chunk in (1500, 4):  # one chunk, and many centres and chunks
        monkeypatch.setattr(cover_tree, "CHUNK", chunk)
        for threshold in (0.98, 0.5):
            count, root = brute_links(rows, threshold)
            got = cover_tree.near_dups(frame(spark, rows), threshold).collect()
            assert len(got) == len(rows)
            for r in got:
                i = r["vec_id"]
                if i is None:
                    assert (r["n_links"], r["component_id"]) == (0, None)
                else:
                    assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], root[i], root[i] == i), (chunk, threshold, i)


def test_near_dups_with_few_centres(spark, monkeypatch):
    """Labels beyond the largest, and those that the sample misses, are one place each; no link is lost."""
    monkeypatch.setattr(cover_tree, "CHUNK", 4)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), i % 9) for i, v in enumerate(rng.normal(size=(90, 8)).astype(np.float32))]
    count, root = brute_links(rows, 0.6)
    for most, sample in ((1, 8192), (3, 2), (2048, 1)):
        got = cover_tree.near_dups(frame(spark, rows), 0.6, max_centres=most, max_sample=sample)
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == {i: (count[i], root[i]) for i, _, _ in rows}


def test_near_dups_of_clusters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        v = rng.normal(size=8)
        rows += [(len(rows) + k, (v + rng.normal(0, 0.06, 8)).astype(np.float32).tolist(), c % 2) for k in range(60)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(500)]  # one very common vector
    count, root = brute_links(rows, 0.98)
    got = cover_tree.near_dups(frame(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (count[i], root[i]) for i, _, _ in rows}
    assert cover_tree.near_dups(frame(spark, rows).limit(0)).count() == 0


def test_tree_covers_its_points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.Tree(x)
    for n, (a, b) in enumerate(t.span):
        d = cover_tree.distance(x[t.order[a:b]], t.centers[n])
        assert d.max() <= t.radii[n] + 1e-7
        kids = t.children[n]
        if len(kids):
            assert sorted(t.span[k] for k in kids)[0][0] == a and sum(t.span[k][1] - t.span[k][0] for k in kids) == b - a
            assert all(t.radii[k] <= t.radii[n] + 1e-7 for k in kids)


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if r == old else r for k, r in root.items()}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == root


def test_sharding_places_every_key(spark):
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.fill(shards, 211)
    assert set(Counter(owner).values()) <= {30, 31}
    rows = spark.createDataFrame([(i, "old", "t") for i in [*range(500), None, 3]], "doc_id long, shard string, of string")
    got = sharding.assign_shards(rows, "doc_id", shards, 211).collect()
    import hashlib

    slot = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % 211
    assert len(got) == 502 and all((r["slot"], r["shard"], r["of"]) == (slot(r["doc_id"]), shards[owner[slot(r["doc_id"])]], "t") for r in got)
    assert sharding.assign_shards(rows.limit(0), "doc_id", shards, 211).count() == 0
    plan = sharding.assign_shards(rows, "doc_id", shards, 211)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan


def test_sharding_moves_few_slots():
    shards = [f"s{i}" for i in range(20)]
    a, b = sharding.fill(shards, 4099), sharding.fill(shards[:-1], 4099)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.1 * 4099


@pytest.mark.parametrize("shards, slots", [(["a"], 10), ([], 7), (["a", "a"], 7), (["a", "b", "c"], 2)])
def test_sharding_refuses(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)
