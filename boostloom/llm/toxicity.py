"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

All terms of the examples are indexed, and norms are over whole texts: a word that no example has counts in
its text's norm.  The index holds a bounded sample of labelled examples, so it is broadcast; every text is a query against
it and rows are never exchanged.

Examples stand in blocks of alike ones.  Rare terms have postings; the weights of frequent terms are kept by
block, with each term's largest weight in the block.  A query adds up the postings of its rare terms, bounds
every block's best score by these sums and the frequent terms' largest weights, and takes the frequent
terms' own weights only in blocks whose bound reaches the k-th best score so far: the k nearest are exact.
Texts are searched in batches, so that bounds and scores are products of matrices.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from boostloom.llm import words as W

SLICE = 4 << 20
#: Examples of a block, and texts that are searched together.
BLOCK, BATCH = 32, 64


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id is the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def alike(rows: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each `size` neighbours are alike: halved along the direction of most variance, again and again."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = rows[at] - rows[at].mean(0)
        direction = x[np.argmax((x * x).sum(1))]
        for _ in range(8):
            direction = x.T @ (x @ direction)
            direction /= max(np.linalg.norm(direction), 1e-300)
        by = at[np.argsort(np.round(x @ direction, 9), kind="stable")]
        half = -(-len(at) // (2 * size)) * size
        todo += [by[half:], by[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Examples in blocks of BLOCK; columns of `dense` and `top` are examples and blocks.

    Term t is the row often[t] of `dense` (weights) and `top` (largest weight by block) if that isn't -1, and
    else has the postings pointer[t]:pointer[t + 1] of `example` and `weight`.
    """

    terms: np.ndarray
    idf: np.ndarray
    often: np.ndarray
    dense: np.ndarray
    top: np.ndarray
    pointer: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    texts: dict[int, np.ndarray]  # examples by the hash of their text

    @staticmethod
    def build(terms: np.ndarray, idf: np.ndarray, example: np.ndarray, term: np.ndarray, count: np.ndarray, ids: np.ndarray, labels: np.ndarray, texts: np.ndarray | None = None, share: float = 1 / 16) -> Index:
        """From (example, term, count) triples; terms of such a share of the examples are frequent."""
        n = len(ids)
        weight = normalised(example, idf[term] * (1 + np.log(count)), n)
        frequent = np.flatnonzero(np.bincount(term, minlength=len(terms)) >= max(1, share * n)) if n else np.zeros(0, np.int64)
        often = np.full(len(terms), -1)
        often[frequent] = np.arange(len(frequent))
        blocks = -(-n // BLOCK)
        dense = np.zeros((len(frequent), blocks * BLOCK))
        mine = often[term] >= 0
        dense[often[term[mine]], example[mine]] = weight[mine]
        order = alike(np.ascontiguousarray(dense[:, :n].T), BLOCK)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        dense[:, :n] = dense[:, order]
        example, term, weight = place[example[~mine]], term[~mine], weight[~mine]
        by = np.lexsort((example, term))
        pointer = np.searchsorted(term[by], np.arange(len(terms) + 1))
        same: dict[int, np.ndarray] = {}
        if texts is not None:
            same = {int(k): np.flatnonzero(texts[order] == k) for k in np.unique(texts)}
        top = dense.reshape(len(frequent), blocks, BLOCK).max(2) if blocks else np.zeros((len(frequent), 0))
        return Index(terms, idf, often, dense, top, pointer, example[by].astype(np.int32), weight[by], ids[order], labels[order], same)

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int, k: int, without: list[np.ndarray | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each document: the k examples of largest cosine over 0 (fewer if there are no more), nearest first, ties to smaller ids, and their cosines."""
        blocks = self.top.shape[1]
        if not blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n_docs
        query = np.zeros((n_docs, len(self.dense)))
        mine = self.often[term] >= 0
        query[doc[mine], self.often[term[mine]]] = weight[mine]
        doc, term, weight = doc[~mine], term[~mine], weight[~mine]
        size = self.pointer[term + 1] - self.pointer[term]
        flat = _spans(self.pointer[term], size)
        cell = np.repeat(doc * (blocks * BLOCK), size) + self.example[flat]
        rare = np.bincount(cell, np.repeat(weight, size) * self.weight[flat], minlength=n_docs * blocks * BLOCK).astype(float, copy=False).reshape(n_docs, blocks * BLOCK)
        for i, x in enumerate(without or []):
            if x is not None:
                rare[i, x] = -np.inf
        rare[:, len(self.ids) :] = -np.inf
        bound = query @ self.top + rare.reshape(n_docs, blocks, BLOCK).max(2)
        score = np.full(rare.shape, -np.inf)

        def take(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(0)):
                rows, columns = np.flatnonzero(which[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                score[rows, columns] = rare[rows, columns] + query[rows] @ self.dense[:, columns]

        first = min(blocks, -(-k // BLOCK) + 4)
        ranked = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        begun = np.zeros(bound.shape, bool)
        np.put_along_axis(begun, ranked, True, axis=1)
        take(begun)
        kth = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
        take((bound >= np.maximum(kth, 0)[:, None] - 1e-9) & ~begun)
        np.round(score, 12, out=score)
        kth = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
        out = []
        for i in range(n_docs):
            found = np.flatnonzero(score[i] >= max(kth[i], 1e-12))
            found = found[np.lexsort((self.ids[found], -score[i, found]))[:k]]
            out.append((found, np.minimum(score[i, found], 1.0)))
        return out


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i] to begin[i] + size[i] - 1, for each i in turn."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def normalised(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights over the Euclidean norm of their owner's."""
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=n))
    return weight / np.maximum(norm[owner], 1e-300) if len(weight) else weight


def isotonic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps (least x of each, value) by pooling adjacent violators, one row of the prior in each."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[by], y[by], strict=True):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b
            pools[-1][2] += 1
        else:
            pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    values = np.maximum.accumulate([(s + prior) / (n + 1) for _, s, n in pools]) if pools else np.zeros(0)
    return np.array([p[0] for p in pools]), np.asarray(values)


@dataclass
class Model:
    index: Index
    k: int
    steps: np.ndarray
    values: np.ndarray
    alone: float

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """The neighbours' labels, weighted by their nearness, the cosine."""
        return float(np.dot(cosine, self.index.labels[best]) / cosine.sum())

    def score(self, vote: float) -> float:
        if not len(self.steps):
            return self.alone
        return float(self.values[max(0, np.searchsorted(self.steps, vote, side="right") - 1)])


def _term_counts(rows: pa.RecordBatch, text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, document, hash, count) for slices of rows; documents by position in the slice."""
    name = rows.schema.names[text]
    for part, buffer, offsets in W.slices(rows, name, SLICE):
        words = W.scan(buffer, offsets, W.ALNUM_LOWER)
        by = np.lexsort((words.hash, words.doc))
        doc, h = words.doc[by], words.hash[by]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
        yield part, doc[new], h[new], np.diff(np.r_[new, len(h)])


def _text_key(text: pa.Scalar) -> int:
    return xxhash.xxh3_64_intdigest(text.as_buffer()) >> 1


def _packed_terms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, label, and the terms and counts of a text, from rows of (doc_id, text, label)."""
    for part, doc, h, count in _term_counts(batch):
        cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
        blobs = [W.pack_sorted(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        counts = [W.pack(count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        texts = [_text_key(x) if x.is_valid else 0 for x in part.column(1)]
        columns = [part.column(0), part.column(2), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary()), pa.array(texts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "terms", "counts", "text"])


def collect_terms(rows: DataFrame, label: str) -> pd.DataFrame:
    """The terms of a bounded number of labelled rows (doc_id, text, label), by doc_id; a row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packed_terms(batch)

    out = rows.select("doc_id", "text", "label").mapInArrow(run, f"doc_id long, label {label}, terms binary, counts binary, text long").toPandas()
    return out.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_examples: int = 6000, k: int = 100, held_out_mod: int | None = 5, relevance: bool = True) -> Model:
    """Fit on at most `max_examples` labelled documents, those with the least xxhash64 of their id.

    Labels count where they are 0 or 1 (the largest, if a document has several) and, with
    `held_out_mod`, where crc32(doc_id as text) modulo it isn't 0.  Terms are runs of letters, digits
    and non-ASCII characters in lower case; the cosine is over all of them, with the weights
    (1 + ln tf) * ln((1 + n) / (1 + df)).  With `relevance` they are multiplied by the relevance frequency
    log2(2 + a / max(1, df - a)), where a counts the examples of label 1 that have the term: 1 for most terms,
    so that none is left out, and more for those that go with the label, without which a few toxic words
    don't show in the cosine of a long text.  Votes are calibrated by isotonic regression over each
    example's vote among those of other texts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out_mod:
        known = known.filter(remainder(F.col("doc_id"), held_out_mod) != 0)
    known = known.groupBy(F.col("doc_id").alias("example_id")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("example_id"), "example_id").limit(max_examples)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(known), F.col("doc_id") == F.col("example_id"))  # at most max_examples rows
    joined = joined.select("doc_id", "text", "label")
    return fit_terms(collect_terms(joined, "double"), k, relevance)


def fit_terms(rows: pd.DataFrame, k: int, relevance: bool = True) -> Model:
    ids, labels = rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy(float)
    n, n_positive = len(ids), labels.sum()
    none = np.zeros(0, np.int64)
    base = float((n_positive + 0.5) / (n + 1))
    if n == 0 or n_positive in (0, n):
        return Model(Index.build(np.zeros(0, np.uint64), np.zeros(0), none, none, none, ids, labels), k, np.zeros(0), np.zeros(0), 0.0 if n_positive == 0 else base)
    hashes = [W.unpack_sorted(x) for x in rows["terms"]]
    counts = np.concatenate([W.unpack(x) for x in rows["counts"]]).astype(np.int64)
    example = np.repeat(np.arange(n), [len(h) for h in hashes])
    vocabulary, term = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.bincount(term, minlength=len(vocabulary)).astype(float)
    idf = np.log((1 + n) / (1 + df))
    if relevance:
        positive = np.bincount(term, labels[example], minlength=len(vocabulary))
        idf *= np.log2(2 + positive / np.maximum(df - positive, 1))
    texts = rows["text"].to_numpy(np.int64)
    index = Index.build(vocabulary, idf, example, term, counts, ids, labels, texts)
    model = Model(index, k, np.zeros(0), np.zeros(0), base)
    weight = normalised(example, idf[term] * (1 + np.log(counts)), n)
    cut = np.searchsorted(example, np.arange(n + 1))
    votes = np.full(n, np.nan)
    for i in range(0, n, BATCH):
        a, b, m = cut[i], cut[min(n, i + BATCH)], min(n, i + BATCH) - i
        for j, (best, cosine) in enumerate(index.nearest(example[a:b] - i, term[a:b], weight[a:b], m, k, [index.texts[int(x)] for x in texts[i : i + m]])):
            if len(best):
                votes[i + j] = model.vote(best, cosine)
    voted = ~np.isnan(votes)
    model.alone = float((labels[~voted].sum() + base) / ((~voted).sum() + 1))
    model.steps, model.values = isotonic(votes[voted], labels[voted], base)
    return model


def _scores(model: Model, part: pa.RecordBatch, doc: np.ndarray, h: np.ndarray, count: np.ndarray, evidence: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and evidence of a slice, whose texts are its second column; examples of the same text don't vote."""
    index, n = model.index, part.num_rows
    if len(index.terms):
        term = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
        known = index.terms[term] == h
    else:
        term, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    # a term of no example weighs what one of document frequency 0 does
    idf = np.where(known, index.idf[term], np.log(1 + len(index.ids))) if len(index.terms) else np.ones(len(h))
    weight = normalised(doc, idf * (1 + np.log(count)), n)[known]
    doc, term = doc[known], term[known]
    cut = np.searchsorted(doc, np.arange(n + 1))
    scores, proofs = np.full(n, model.alone), [[] for _ in range(n)]
    for first in range(0, n, BATCH):
        last = min(n, first + BATCH)
        a, b = cut[first], cut[last]
        same = [index.texts.get(_text_key(x)) if x.is_valid else None for x in part.column(1).slice(first, last - first)]
        for i, (best, cosine) in enumerate(index.nearest(doc[a:b] - first, term[a:b], weight[a:b], last - first, model.k, same), first):
            if len(best):
                scores[i] = model.score(model.vote(best, cosine))
                proofs[i] = [{"doc_id": int(index.ids[x]), "label": int(index.labels[x]), "cosine": float(c)} for x, c in zip(best[:evidence], cosine, strict=False)]
    return scores, proofs


def score_documents(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """Score every whole text: doc_id, score, predicted, evidence.

    `score` (0 to 1) is the calibrated vote of the k nearest examples, `predicted` is 1 from 0.5 on,
    `evidence` lists the nearest ones as (doc_id, label, cosine).  A text that shares no term with any example
    (also a null or empty one) has no neighbours and gets the rate of the label among such examples; a
    model without examples, or without label 1 among them, scores 0.  Examples of the very same
    text have no vote, so that training documents are judged as others are; ids, labels, languages and
    sources aren't looked at.  Repeated rows give equal rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by max_examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(shared.value)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            for part, doc, h, count in _term_counts(batch):
                scores, proofs = _scores(model, part, doc, h, count, evidence)
                columns = [part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(proofs, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, label: int, cosine: double>>")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores under `threshold`, with all their columns; scores as in score_documents()."""
    # bounded by max_examples; as itself and not as bytes, which a worker would keep beside the model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    # the text goes to the workers once; it comes back as it went
    apart = names.count("text") == 1 and docs.schema["text"].dataType == StringType()
    beside = [c for c in names if not apart or c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in beside]).alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part, doc, h, count in _term_counts(batch):
                keep = _scores(model, part, doc, h, count, 0)[0] < threshold
                yield part.select([1, 2] if apart else [2]).filter(pa.array(keep))

    kept = rows.mapInArrow(run, rows.select(*["__text"] * apart, "__row").schema)
    return kept.select(*[(F.col("__row")[c] if c in beside else F.col("__text")).alias(c) for c in names])
