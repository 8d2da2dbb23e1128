"""Mixing to target weights with soft memberships.

A classifier fitted on the labelled table gives each document a posterior over domains; document rates
r >= 0 are fitted so that the expected token totals of the domains, sum over i of r_i n_i p_ik, match
their targets.  The rates solve

    min  1/2 sum_k ((sum_i r_i n_i p_ik - T_k) / N)^2 + ridge / 2 sum_i (n_i / N) (r_i - 1)^2,   r >= 0

(N: all tokens) by projected gradient: a point moves against the gradient and the rates are its projection
onto the bounds.  The gradient at a document is a linear function of its posterior, so the point is one small
vector for all documents, r_i = max(lower, 1 - p_i . point), and no rate is stored.  Steps are
scaled by the inverse of the second-moment matrix of the posteriors of documents that aren't at their
bound (domains by domains) and halved until the dual objective rises enough.  A round is one pass that
sums vectors by partition: what travels is one of them for each partition, and a lost executor costs a
recomputation, no state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boostloom.llm import words as W
from boostloom.llm.shared import written
from boostloom.llm.toxicity import collect_terms

SLICE = 4 << 20


@dataclass
class Classifier:
    """Multinomial naive Bayes over chosen terms, with a temperature that calibrates its posteriors."""

    domains: list[str]
    terms: np.ndarray
    weight: np.ndarray  # log P(term | domain), one row more for all other terms
    prior: np.ndarray
    temperature: float

    def posterior(self, doc: np.ndarray, hashes: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
        """From (document, term, count) triples; a document's counts of a term may come in several."""
        out = np.tile(self.prior, (n_docs, 1))
        if len(self.terms) and len(hashes):
            at = lookup(self.terms, hashes)
            known = np.flatnonzero(at >= 0)
            d, at, n, v = doc[known], at[known], count[known], len(self.terms)
            for first in range(0, n_docs, 256):  # a table of some documents by all terms at a time
                last = min(n_docs, first + 256)
                a, b = np.searchsorted(d, [first, last])
                table = np.bincount((d[a:b] - first) * v + at[a:b], n[a:b])
                used = np.flatnonzero(table)
                evidence = self.temperature * np.log1p(table[used])
                for k in range(len(self.domains)):
                    out[first:last, k] += np.bincount(used // v, evidence * self.weight[used % v, k], minlength=last - first)
        out -= out.max(1, keepdims=True)
        out = np.exp(out)
        return out / out.sum(1, keepdims=True)


def lookup(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of hashes among sorted terms, or -1: by their first 16 bits, then one after the other."""
    first = np.searchsorted(terms, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
    size = np.diff(np.r_[first, len(terms)])
    bucket = (hashes >> np.uint64(48)).astype(np.int64)
    out = np.full(len(hashes), -1)
    for k in range(int(size.max())):
        may = np.flatnonzero(size[bucket] > k)
        place = first[bucket[may]] + k
        hit = terms[place] == hashes[may]
        out[may[hit]] = place[hit]
    return out


def fit_classifier(docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), max_examples: int = 6000, max_terms: int = 4096, min_df: int = 3) -> Classifier:
    """Fit on at most `max_examples` labelled documents, those with the least xxhash64 of their id.

    A domain is a combination of the label columns' values that occurs, in text, as quality=1,toxic=0.
    Labels with a null in one of the columns don't count.  Terms are runs of letters, digits and
    non-ASCII characters in lower case; those that tell the domains apart best are chosen.
    """
    known = labels.filter(F.col("doc_id").isNotNull())
    for c in label_cols:
        known = known.filter(F.col(c).isNotNull())
    name = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in label_cols])
    known = known.groupBy(F.col("doc_id").alias("example_id")).agg(F.max(name).alias("label"))
    known = known.orderBy(F.xxhash64("example_id"), "example_id").limit(max_examples)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), F.col("doc_id") == F.col("example_id")).select("doc_id", "text", "label")  # at most max_examples rows
    rows = collect_terms(rows, "string")
    domains = sorted(set(rows["label"]))
    if not domains:
        return Classifier(["all"], np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros(1), 0.0)
    label = np.searchsorted(domains, rows["label"].to_numpy(str))
    hashes = [W.unpack_sorted(x) for x in rows["terms"]]
    count = np.log1p(np.concatenate([W.unpack(x) for x in rows["counts"]]).astype(float))
    example = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    return _fit(domains, label, np.concatenate(hashes), count, example, max_terms, min_df)


def _fit(domains: list[str], label: np.ndarray, hashes: np.ndarray, count: np.ndarray, example: np.ndarray, max_terms: int, min_df: int) -> Classifier:
    n, k = len(label), len(domains)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    df = np.bincount(term, minlength=len(vocabulary))
    sums = np.stack([np.bincount(term, count * (label[example] == j), minlength=len(vocabulary)) for j in range(k)], 1)
    of_domain = np.maximum(np.bincount(label, minlength=k), 1)
    seen = np.stack([np.bincount(term, label[example] == j, minlength=len(vocabulary)) for j in range(k)], 1)
    expected = df[:, None] * of_domain / n
    spread = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(1)
    spread[df < min_df] = -1
    chosen = np.sort(np.lexsort((np.arange(len(df)), -spread))[: min(max_terms, int((spread >= 0).sum()))])
    share = (sums[chosen] + 0.5) / (sums[chosen].sum(0) + 0.5 * (len(chosen) + 1))
    weight = np.log(share)
    weight -= weight.mean(1, keepdims=True)
    model = Classifier(domains, vocabulary[chosen], weight, np.log(of_domain / n), 1.0)
    # temperatures from next to no evidence to all of it; terms aren't independent, so low ones fit better
    count = np.expm1(count)
    best = (np.inf, 1.0)
    for t in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0):
        model.temperature = t
        loss = -np.log(np.maximum(model.posterior(example, hashes, count, n)[np.arange(n), label], 1e-12)).mean()
        best = min(best, (loss, t))
    model.temperature = best[1]
    return model


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words without U+0020 and U+0009..U+000D), posterior array<double>, for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # its size is bounded by max_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = pickle.loads(shared.value)
        k = len(model.domains)
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                tokens, p = _posterior(model, buffer, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), lists], names=["doc_id", "n_tokens", "posterior"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def _posterior(model: Classifier, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and posteriors of the texts of a slice."""
    words = W.scan(buffer, offsets, W.ALNUM_LOWER)
    return _token_counts(buffer, offsets), model.posterior(words.doc, words.hash, np.ones(len(words.doc)), words.n_docs)


def _token_counts(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document."""
    word = np.zeros(int(offsets[-1] - offsets[0]) + 1, np.int8)
    word[1:] = W.PLAIN[buffer[offsets[0] : offsets[-1]]] != 0
    at = offsets - offsets[0]
    out = np.diff(np.searchsorted(np.flatnonzero(np.diff(word) == 1), at))
    full = np.flatnonzero(np.diff(at) > 0)
    return out + np.bincount(full[(word[at[full]] == 1) & (word[at[full] + 1] == 1)], minlength=len(out))  # a text may touch the one before


def rates(p: np.ndarray, point: np.ndarray, least: float = 0.0) -> np.ndarray:
    return np.maximum(least, 1.0 - p @ point)


@dataclass
class Mix:
    """A solution: the point that gives any document's rate, what the totals come to, and the points on the way."""

    domains: list[str]
    point: np.ndarray
    before: np.ndarray
    targets: np.ndarray
    after: np.ndarray
    lower: float = 0.0
    converged: bool = True
    history: list[np.ndarray] = field(default_factory=list)

    @property
    def unmet(self) -> dict[str, float]:
        """What each domain's total lacks of its target (negative where it is over), as a share of the target."""
        return dict(zip(self.domains, ((self.targets - self.after) / np.maximum(self.targets, 1.0)).tolist(), strict=True))

    def rate(self, p: np.ndarray) -> np.ndarray:
        return rates(p, self.point, self.lower)


def solve(table: DataFrame, domains: list[str], targets: Callable[[np.ndarray], np.ndarray], ridge: float = 1e-4, lower: float = 0.0, most_rounds: int | None = None, tolerance: float = 1e-4) -> Mix:
    """Fit the rates over a table of posteriors(), which should be written out: each round reads it once.

    `targets` gets the domains' present token totals and returns the wanted ones.  Rates are at least
    `lower` (0 or more; with 1 and targets over the present totals, no document is lost).  Rounds end when each
    domain's total is within `tolerance` of its own target (as a share of that target) or when the objective
    is within a millionth of its dual bound; what is missing then (targets may be out of reach, and the
    ridge pulls rates to 1) is the solution's `unmet`.  With `most_rounds` they may end before, which
    `converged` tells.
    """
    k = len(domains)
    sc = table.sparkSession.sparkContext
    ridge = max(ridge, 1e-9)

    def sums(point: np.ndarray) -> np.ndarray:
        """Totals now and at the rates, tokens times squared moves, tokens, and second moments of the free documents' posteriors."""
        shared = sc.broadcast(point)
        size = 2 * k + 2 + k * k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                r = rates(p, shared.value, lower)
                free = p[r > lower]
                total += np.r_[n @ p, (n * r) @ p, n @ (r - 1) ** 2, n.sum(), ((free * n[r > lower, None]).T @ free).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

        parts = table.select("n_tokens", "posterior").mapInArrow(run, "total array<double>")
        cells = parts.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(size)
        for row in cells:
            out[row["i"]] = row["x"]
        return out

    now = sums(np.zeros(k))
    before, n = now[:k], now[2 * k + 1]
    wanted = np.asarray(targets(before), float)
    if n <= 0:
        return Mix(domains, np.zeros(k), before, wanted, before, lower)
    dual = lambda x, mu: -0.5 * mu @ mu + 0.5 * ridge * x[2 * k] / n + mu @ (x[k : 2 * k] - wanted) / n
    mu, history, converged = np.zeros(k), [], False
    while not converged and (most_rounds is None or len(history) < most_rounds):
        gap = (now[k : 2 * k] - wanted) / n
        value = 0.5 * gap @ gap + 0.5 * ridge * now[2 * k] / n
        converged = bool((np.abs(now[k : 2 * k] - wanted) <= tolerance * np.maximum(wanted, 1.0)).all() or value - dual(now, mu) <= 1e-6 * value)
        if converged:
            break
        step = np.linalg.solve(np.eye(k) + now[2 * k + 2 :].reshape(k, k) / (n * ridge), gap - mu)
        size, rise = 1.0, (gap - mu) @ step
        while True:
            after = sums((mu + size * step) / ridge)
            if dual(after, mu + size * step) >= dual(now, mu) + 1e-4 * size * rise or size < 1e-6:
                break
            size /= 2
        converged = size < 1e-6  # no step is left that rounding lets rise
        mu, now = mu + size * step, after
        history.append(mu / ridge)
    return Mix(domains, mu / ridge, before, wanted, now[k : 2 * k], lower, converged, history)


def raised(floor: float = 1.0, shares: dict[str, float] | None = None, domains: list[str] | None = None, most: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Targets that lower no domain: totals by the wanted shares, each at least `floor` times the present one.

    Without shares, the square roots of the present totals: rare domains gain.  A domain of no share stays
    as it is.  With `most`, no total grows to more than so many times the present one, so that shares may be missed.
    """

    def targets(present: np.ndarray) -> np.ndarray:
        live = np.maximum(present, 1e-9)
        want = np.array([shares.get(d, 0.0) for d in domains]) if shares else np.sqrt(live)
        scale = (live[want > 0] / want[want > 0]).max(initial=0.0)  # the domain that is richest by its share stays as it is
        wanted = np.maximum(want * scale, floor * live)
        return wanted if most is None else np.minimum(wanted, most * live)

    return targets


def fit(docs: DataFrame, labels: DataFrame, targets: Callable[[list[str]], Callable[[np.ndarray], np.ndarray]] | None = None, ridge: float = 1e-4, lower: float = 0.0) -> tuple[Classifier, Mix, DataFrame]:
    """The classifier, the rates' solution, and the written table of posteriors that it was found on.

    `targets` gets the domains' names and returns the function that solve() wants; raised() by default.
    """
    model = fit_classifier(docs, labels)
    table = written(posteriors(docs, model))
    return model, solve(table, model.domains, (targets or (lambda d: raised(domains=d)))(model.domains), ridge, lower), table


def _copies(rate: str):
    """A rate rounded up or down by the id's hash."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col(rate) + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, Mix]:
    """Rates for every document: (doc_id, n_tokens, posterior map, rate, copies), and the solution.

    `copies` is the rate rounded up or down at random by the id's hash, so that its expectation is the
    rate; a rate of 1 or more keeps every document.  Null and empty texts have no tokens; their
    posterior is the classifier's prior.  Without usable labels there is one domain and all rates are 1.
    Repeated rows count each and get equal rates; other columns are ignored; an empty table gives no rows.
    Options are those of fit().
    """
    model, solution, table = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(solution)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value.domains)
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.rate(p))], names=["doc_id", "n_tokens", "posterior", "rate"])

    rated = table.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double")
    names = F.array(*[F.lit(d) for d in model.domains])
    return rated.select("doc_id", "n_tokens", F.map_from_arrays(names, "posterior").alias("posterior"), "rate", _copies("rate").alias("copies")), solution


def resample(docs: DataFrame, model: Classifier, solution: Mix) -> DataFrame:
    """Each row as often as its rate says (rounded as in mix()), with all its columns; no row is exchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model, solution)))
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, solution = pickle.loads(shared.value)
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                _, p = _posterior(model, buffer, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(solution.rate(p))], names=["doc_id", "row", "rate"])

    kind = T.StructType([T.StructField("doc_id", T.LongType()), rows.schema["row"], T.StructField("rate", T.DoubleType())])
    rated = rows.mapInArrow(run, kind)
    copies = _copies("rate")
    repeated = rated.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return repeated.select(*[F.col("row")[c].alias(c) for c in names])
