"""Hot groups are spread over tasks even where joins aren't broadcast."""

import re
from contextlib import contextmanager

import numpy as np
import pytest

from boostloom.llm import cover_tree, languages, near_dups
from boostloom.llm import words as W


@contextmanager
def sort_merge(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def recorder(monkeypatch, module):
    """Plans of all tables that a module writes."""
    plans, written = [], module.written

    def record(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return written(rows)

    monkeypatch.setattr(module, "written", record)
    return plans


def test_chunk_pairs_of_one_label_are_dealt_by_chunk(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[150:] = x[:150] + rng.normal(0, 0.02, (150, 8))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(cover_tree, "CHUNK", 40)
    plans = recorder(monkeypatch, cover_tree)
    with sort_merge(spark):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_dups(rows, 0.98, max_centres=1).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(300, dtype=bool)
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(near.sum(1).tolist()))
    (plan,) = [p for p in plans if "FlatMapGroupsInPandas" in p]
    nearest = re.search(r"FlatMapGroupsInPandas.*?Exchange hashpartitioning\(([^)]*)\)", plan, re.S).group(1)
    assert [re.sub(r"#.*", "", c.strip()) for c in nearest.split(",")][:4] == ["label", "centre", "i", "j"]


def test_members_of_one_bucket_meet_their_least_by_salt(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    texts = [f"{text} x{i}" for i in range(300)] + [" ".join(f"{j}v{i}" for i in range(50)) for j in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans = recorder(monkeypatch, near_dups)
    with sort_merge(spark):
        got = {r["doc_id"]: r["component_id"] for r in near_dups.near_dups(docs).collect()}
    assert got == {i: 0 if i < 300 else i for i in range(320)}
    (plan,) = [p for p in plans if "least" in p and "salt" in p and "SortMergeJoin" in p and "component" not in p]
    last = [re.sub(r"#.*", "", c.strip()) for c in re.search(r"SortMergeJoin \[([^\]]*)\]", plan).group(1).split(",")]
    assert last == ["bucket", "salt"]


@pytest.mark.parametrize("codes", [3, 400])
def test_languages_are_counted_by_what_they_have(spark, codes):
    rng = np.random.default_rng(codes)
    rows = [(i, f"c{i % codes}", "".join(rng.choice(list("abcdé "), 40))) for i in range(2 * codes)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    model = languages.fit(docs, held_out_mod=None)
    assert model.languages == sorted({r[1] for r in rows})
    for lang in model.languages[:3]:
        counts = np.zeros(languages.CELLS)
        for _, code, text in rows:
            if code == lang:
                raw = np.frombuffer(text.encode(), np.uint8)
                np.add.at(counts, languages.grams(raw, np.array([0, len(raw)]))[1], 1)
        counts = np.r_[counts[model.cells], 0.0]
        want = (counts + 0.05) / (counts.sum() + 0.05 * len(counts))
        assert model.rows[:, model.languages.index(lang)] == pytest.approx(want, rel=1e-5)
    assert W.unpack_sorted(W.pack_sorted(model.cells.astype(np.uint64))).tolist() == model.cells.tolist()
