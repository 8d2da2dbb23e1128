"""Language identification as a mixture: proportions by expectation-maximisation over n-gram likelihoods.

The n-grams are three neighbouring bytes of letters (word borders count as one; bytes outside ASCII are letters, all told
apart).  A language's model has a row for each n-gram that the training texts have.  A text's n-grams are drawn from a mixture of the languages'
tables; EM finds the proportions, and the set of languages is the one of largest penalised likelihood.
Rows are never exchanged; the broadcast grows with the number of languages only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostloom.llm import words as W

SLICE = 2 << 20
#: Byte classes: 0 for borders, 1-26 for letters, the rest for the bytes outside ASCII.
CLASSES = 27 + 128
CELLS = CLASSES**3
UNKNOWN = "und"
_LETTER = re.compile(r"[A-Za-z]")


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    out[128:] = np.arange(27, CLASSES)
    return out


_CLASS = _classes()


def grams(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of each n-gram with a letter in its middle; texts are set apart by borders."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    flat = np.zeros(int(sizes.sum()) + n + 1, np.uint32)
    place = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, n + 1), sizes)
    flat[place] = _CLASS[buffer[offsets[0] : offsets[-1]]]
    middle = np.flatnonzero(flat[1:-1]) + 1 if len(flat) > 2 else np.zeros(0, np.int64)
    cell = flat[middle - 1] * CLASSES**2 + flat[middle] * CLASSES + flat[middle + 1]
    doc = np.searchsorted(offsets[1:] - offsets[0] + np.arange(1, n + 1), middle, side="right")
    return doc, cell


def _counted(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, cell, count), sorted."""
    doc, cell = grams(buffer, offsets)
    key = doc.astype(np.int64) * CELLS + cell
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new] // CELLS, key[new] % CELLS, np.diff(np.r_[new, len(key)]).astype(np.float32)


class Model:
    """Likelihoods by language of the cells that training texts have, and of any other one (the last row)."""

    def __init__(self, languages: list[str], cells: np.ndarray, counts: np.ndarray, alpha: float = 0.05):
        self.languages, self.cells = languages, cells
        counts = np.vstack([counts, np.zeros(counts.shape[1])])
        self.rows = ((counts + alpha) / (counts.sum(0) + alpha * len(counts))).astype(np.float32)
        self._place: np.ndarray | None = None

    def likelihood(self, cell: np.ndarray) -> np.ndarray:
        if self._place is None:  # made where it is used: it is larger than what it is made of
            self._place = np.full(CELLS, len(self.cells), np.int32)
            self._place[self.cells] = np.arange(len(self.cells))
        return self.rows[self._place[cell]]


def fit(docs: DataFrame, lang_col: str = "lang", max_docs: int = 6000, held_out_mod: int | None = 5) -> Model:
    """Fit on whole texts of at most `max_docs` documents with a language, those of least xxhash64 of their id.

    With `held_out_mod`, only documents whose crc32(doc_id as text) modulo it isn't 0.  What is broadcast has a
    number for each language and each n-gram of the training texts.
    """
    from boostloom.llm.toxicity import remainder

    known = docs.select("doc_id", F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out_mod:
        known = known.filter(remainder(F.col("doc_id"), held_out_mod) != 0)
    chosen = known.select(F.col("doc_id").alias("pick_id")).distinct().orderBy(F.xxhash64("pick_id"), "pick_id").limit(max_docs)
    rows = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("pick_id"))  # at most max_docs rows
    rows = rows.select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # (language, cell), as many as there are
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                of = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], np.int64)
                doc, cell = grams(buffer, offsets)
                found, n = np.unique(of[doc] * CELLS + cell, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        cut = np.searchsorted(keys, np.arange(len(names) + 1) * CELLS)
        for lang, a, b in zip(names, cut, cut[1:], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([W.pack_sorted(keys[a:b] % CELLS)]), pa.array([W.pack(counts[a:b])])], names=["lang", "cells", "counts"])

    found = rows.mapInArrow(run, "lang string, cells binary, counts binary").toPandas()
    languages = sorted(found["lang"].unique())
    lists = [W.unpack_sorted(x).astype(np.int64) for x in found["cells"]]
    every = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    counts = np.zeros((len(every), max(1, len(languages))))
    for cells, lang, n in zip(lists, found["lang"], found["counts"], strict=True):
        counts[np.searchsorted(every, cells), languages.index(lang)] += W.unpack(n)
    return Model(languages, every, counts)


def em(doc: np.ndarray, count: np.ndarray, q: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages, over the allowed ones) and log likelihoods after `rounds` of EM.

    doc is sorted and holds each document's position; every document has at least one row.
    """
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total = np.add.reduceat(count, new)[:, None]
    p = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        r = q * p.astype(np.float32)[doc]
        r *= (count / r.sum(1))[:, None]
        p = np.add.reduceat(r, new, axis=0).astype(float) / total
    value = np.add.reduceat(count * np.log((q * p.astype(np.float32)[doc]).sum(1)), new)
    return p, value.astype(float)


def select_languages(doc: np.ndarray, count: np.ndarray, q: np.ndarray, rounds: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the selected set, proportions over all languages).

    Sets are nested by the proportions over all languages.  A further language must raise the log
    likelihood by log(n) / 2 and by `gain` for each of the text's n n-grams.
    """
    n_docs, n_lang = int(doc[-1]) + 1, q.shape[1]
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total = np.add.reduceat(count, new).astype(float)
    full, value = em(doc, count, q, np.ones((n_docs, n_lang)), rounds)
    single = np.add.reduceat(count[:, None] * np.log(q), new, axis=0).astype(float)
    best = single.argmax(1)
    price = np.log(np.maximum(total, 2)) / 2 + gain * total
    out = np.zeros_like(full)
    out[np.arange(n_docs), best] = 1.0
    # the likelihood is concave: no mixture's is over this one's by more than the steepest slope towards one language
    slope = np.add.reduceat(q * (count / (q * full.astype(np.float32)[doc]).sum(1))[:, None], new, axis=0).astype(float)
    most = value + np.maximum(slope.max(1) - total, 0)
    several = np.flatnonzero(most - price > single[np.arange(n_docs), best]) if n_lang > 1 else np.zeros(0, np.int64)
    if len(several):
        place = np.full(n_docs, -1)
        place[several] = np.arange(len(several))
        mine = place[doc] >= 0
        d, c, qq = place[doc[mine]], count[mine], q[mine]
        order = np.argsort(-full[several], axis=1, kind="stable")
        reached = single[several, best[several]]
        for k in range(2, n_lang + 1):
            allowed = np.zeros((len(several), n_lang))
            np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
            p, v = em(d, c, qq, allowed, 5 * rounds)
            v = v - (k - 1) * price[several]
            better = v > reached
            out[several[better]], reached = p[better], np.where(better, v, reached)
    return out, full


def identify(docs: DataFrame, model: Model, rounds: int = 6, gain: float = 0.02) -> DataFrame:
    """Identify the languages of every whole text: doc_id, lang_pred, score, mixture.

    `mixture` maps the selected languages to their proportions, `lang_pred` has the largest (ties: the
    first by name) and `score` is its proportion when all languages may take part.  A null text, one
    without a letter, one whose letters no n-gram covers, and all texts under a model without languages
    give `und`, 0 and an empty map.  Repeated rows give equal rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                preds, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                mixtures: list[list] = [[] for _ in range(part.num_rows)]
                doc, cell, count = _counted(buffer, offsets)
                if len(doc) and model.languages:
                    rows, place = np.unique(doc, return_inverse=True)
                    chosen, full = select_languages(place, count, model.likelihood(cell), rounds, gain)
                    texts = part.column(1)
                    for i, row in enumerate(rows):
                        text = texts[int(row)].as_py()
                        if not (_LETTER.search(text) or any(map(str.isalpha, text))):
                            continue
                        top = int(chosen[i].argmax())
                        preds[row], scores[row] = model.languages[top], min(1.0, max(0.0, full[i, top]))
                        mixtures[row] = [(model.languages[j], float(chosen[i, j])) for j in np.flatnonzero(chosen[i] > 0)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds), pa.array(scores), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string, double>")
