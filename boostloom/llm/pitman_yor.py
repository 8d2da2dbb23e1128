"""A hierarchical Pitman-Yor bigram model, seated by Gibbs sampling over the whole corpus.

Restaurants: one for each token that another follows (and one for the start of a text); their common
parent is the unigram restaurant, whose base is uniform over the tokens seen in training and one more for
all others.  Tables of a child are customers of the parent.

A seating of c customers who all have the same dish is told by the customers that open a table.  A
sweep gets all customers of a dish in a restaurant up and seats them anew, one by one, given everyone
else; a Metropolis test makes this block a draw from its exact conditional.  It takes steps by tables,
not by customers, so that the most frequent pair of a corpus is as cheap as others.  All dishes are
seated at once given the totals of the sweep before (a synchronous sweep): restaurants' tables and
parents' seats are exchanged between sweeps.

Tokens are dealt out by hash to places of a bounded number of tokens.  Tokens so frequent that they
would fill a place are spread over all places by context; there are 8 for each shuffle partition at
most, and only their totals go through the driver.  Restaurants have owners, likewise by hash: places send
them tables by context and get the totals back.  All draws are functions of the tokens and the sweep, and
sums are of whole numbers, so that scores don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostloom.llm import words as W
from boostloom.llm.shared import discard, written
from boostloom.llm.substrings import join_blobs, split_blobs
from boostloom.llm.toxicity import remainder

SLICE = 6 << 20
#: Tokens of a place.
PLACE = 1_500_000
END = np.uint64(0x2545F4914F6CDD1D)
#: The restaurant of the start of a text; sorts last.
START = np.uint64(2**64 - 1)
#: Logarithms are summed as whole multiples of this.
UNIT = 1e-8
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows that meet in a place.
STATE, REPLY, MESSAGE, SUMS, PAIRS, ENTRIES, HEADS = range(7)
_ROWS = "kind int, place int, key int, blob binary"


@dataclass
class Tokens:
    """Tokens of a slice: hash, text, and whether the token before is the text's start."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def tokens(buffer: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words with A-Z in lower case, and one end for each text."""
    words = W.scan(buffer, offsets, W.PLAIN_LOWER)
    n = words.counts()
    ends = np.cumsum(n + 1) - 1
    hashes = np.full(int((n + 1).sum()), END, np.uint64)
    inner = np.ones(len(hashes), bool)
    inner[ends] = False
    hashes[inner] = words.hash
    doc = np.repeat(np.arange(len(n)), n + 1)
    return Tokens(hashes, doc, np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool))


# Seating


def _gamma_ratio(x: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """ln(gamma(x + delta) / gamma(x)) for positive x and x + delta, by Stirling's series from 8 on."""
    y = x + delta
    up = np.ones(len(x))
    for i in range(8):
        up *= (x + i) / (y + i)
    x, y = x + 8, y + 8
    series = lambda v: (1 / 12 - (1 / 360 - 1 / 1260 / (v * v)) / (v * v)) / v
    return np.log(up) + (x - 0.5) * np.log1p(delta / x) + delta * (np.log(y) - 1) + series(y) - series(x)


def uniform(key: np.ndarray, sweep: int, draw: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on the arguments only."""
    at = np.uint64((sweep * 0xD1342543DE82EF95 + draw * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    return ((W.mix(key ^ W.mix(np.full(1, at))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _walk(customers: np.ndarray, a: np.ndarray, p: np.ndarray, discount: float, draw, given: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seats the customers of each dish one by one: (tables opened after the first, who opened, log weight).

    With k customers at j tables, the next opens a table with the weight (a + discount * j) * p against
    k - discount * j; of the proposal, the former weighs less by (l / customers) ** discount, for the largest power of two l up
    to k, as early tables make all later ones less likely to be needed.  Who opens the next table is drawn at once
    from the product of the odds up to there.  With `given` (numbers, openers) the seating is replayed.
    The log weight is that of the target against the proposal, but for what all seatings of a dish share.
    """
    n = len(customers)
    customers = customers.astype(float)
    k, j, weight = np.ones(n), np.ones(n), np.zeros(n)
    if given is not None:
        following = np.cumsum(given[0]) - given[0]
        last = following + given[0]
        openers = np.append(given[1].astype(float), np.inf)
    who, by = [], []
    active, step = np.flatnonzero(customers > 1), 0
    while len(active):
        at, tables, most = k[active], j[active], customers[active]
        low = np.ldexp(0.5, np.frexp(at)[1])
        end = np.minimum(2 * low, most)
        more = np.maximum(a[active] * p[active] - discount * tables, 0)
        tilt = ((low + more) / (most + more)) ** (discount * (1 - p[active]))
        odds = (a[active] + discount * tables) * p[active] * tilt
        if given is None:
            x = at - discount * tables
            start = _gamma_ratio(x, odds)
            u = np.log(draw(active, step))
            opens = u >= start - _gamma_ratio(end - discount * tables, odds)
            opener = np.full(len(active), np.inf)
            o = np.flatnonzero(opens)
            lo, hi = at[o].copy(), end[o].copy()  # none opens up to lo, some before hi
            open_ = np.flatnonzero(hi - lo > 1)
            while len(open_):
                mid = np.floor((lo[open_] + hi[open_]) / 2)
                i = o[open_]
                none = u[i] < start[i] - _gamma_ratio(mid - discount * tables[i], odds[i])
                lo[open_[none]] = mid[none]
                hi[open_[~none]] = mid[~none]
                open_ = open_[hi[open_] - lo[open_] > 1]
            opener[o] = lo
        else:
            opener = openers[np.where(following[active] < last[active], following[active], len(openers) - 1)]
            opens = opener < end
            following[active[opens]] += 1
        stop = np.where(opens, opener + 1, end)
        delta = odds - discount * tables
        weight[active] += _gamma_ratio(stop, delta) - _gamma_ratio(at, delta) - np.where(opens, np.log(tilt), 0)
        k[active] = stop
        j[active[opens]] += 1
        who.append(active[opens])
        by.append(opener[opens])
        active = active[k[active] < customers[active]]
        step += 1
    who = np.concatenate(who) if who else np.zeros(0, np.int64)
    by = np.concatenate(by) if by else np.zeros(0)
    order = np.argsort(who, kind="stable")
    return (j - 1).astype(np.int64), by[order].astype(np.int64), weight


def reseat(customers: np.ndarray, opened: np.ndarray, openers: np.ndarray, a: np.ndarray, p: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables opened after the first, openers) of each dish, drawn anew given everyone else.

    `a` is the strength and the discount times the restaurant's tables of other dishes, `p` the dish's
    probability in the parent.  The walk is the proposal; a Metropolis test against the seating before, which it
    keeps if it fails, leaves the exact conditional as it is.
    """
    fits = openers < np.repeat(customers, opened)  # parents lose customers between sweeps
    opened = np.bincount(np.repeat(np.arange(len(opened)), opened)[fits], minlength=len(opened))
    openers = openers[fits]
    new, by, weight = _walk(customers, a, p, discount, lambda i, step: uniform(key[i], sweep, step + 1), None)
    _, _, before = _walk(customers, a, p, discount, None, (opened, openers))
    taken = np.log(uniform(key, sweep, 0)) < weight - before
    out = np.where(taken, new, opened)
    from_new, from_old = np.repeat(taken, new), np.repeat(~taken, opened)
    who = np.r_[np.repeat(np.arange(len(new)), new)[from_new], np.repeat(np.arange(len(new)), opened)[from_old]]
    return out, np.r_[by[from_new], openers[from_old]][np.argsort(who, kind="stable")]


# Dealing out


def _frequent_here(share: float):
    """The slice's number of tokens (token null), and its tokens of such a share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buffer, offsets in W.slices(batch, "text", SLICE):
                t = tokens(buffer, offsets)
                h, n = np.unique(t.hash, return_counts=True)
                top = n >= share * len(t.hash)
                token = pa.array(np.r_[h[top], np.uint64(0)].view(np.int64), mask=np.r_[np.zeros(top.sum(), bool), True])
                yield pa.RecordBatch.from_arrays([token, pa.array(np.r_[n[top], len(t.hash)].astype(np.int64))], names=["token", "n"])

    return run


def _at(hashes: np.ndarray, places: int) -> np.ndarray:
    """The place of each hash; grows with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)).astype(np.int64)


def owners(places: int) -> int:
    """Owners of restaurants: few, as every place may write to each."""
    return min(places, 4 * math.isqrt(places))


def _is_in(some: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The position of each value among the sorted `some`, or -1."""
    if not len(some):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(some, values), len(some) - 1)
    return np.where(some[at] == values, at, -1)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i] to begin[i] + size[i] - 1, for each i in turn."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _deal(frequent: np.ndarray, places: int):
    """Packs a slice's (token, context, text) counts by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                t = tokens(buffer, offsets)
                held = part.column(2).to_numpy(zero_copy_only=False)
                distinct, token = np.unique(t.hash, return_inverse=True)
                context = np.r_[0, token[:-1]]
                context[t.first] = len(distinct)
                as_context = np.append(distinct, START)
                doc_bits = max(1, part.num_rows.bit_length())
                key = np.sort((token * len(as_context) + context) << doc_bits | t.doc)
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                count = np.diff(np.r_[new, len(key)])
                pair, doc = key[new] >> doc_bits, key[new] & ((1 << doc_bits) - 1)
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(pair)])
                token, context = np.divmod(pair[first], len(as_context))
                cell = _at(distinct, places)[token]
                often = (_is_in(frequent, distinct) >= 0)[token]
                cell[often] = _at(W.mix(distinct[token[often]] + W.mix(as_context[context[often]])), places)
                order = np.argsort(cell, kind="stable")
                cell, token, context = cell[order], token[order], context[order]
                entries = _spans(first[order], n[order])
                n, doc, count = n[order], doc[entries], count[entries]
                cut = np.searchsorted(cell, np.arange(places + 1))
                begin = np.r_[0, np.cumsum(n)][cut]
                serial += 1
                rows, outs = [], W.pack(held)
                for c in range(places):
                    a, b = cut[c], cut[c + 1]
                    if a == b:
                        continue
                    w = token[a:b]
                    at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    mine, index = np.unique(context[a:b], return_inverse=True)
                    x, y = begin[c], begin[c + 1]
                    blob = [W.pack_sorted(distinct[w[at]]), W.pack(np.diff(np.r_[at, b - a])), W.pack_sorted(as_context[mine]), W.pack(index), W.pack(n[a:b] - 1), W.pack(doc[x:y]), W.pack(count[x:y] - 1), outs]
                    rows.append((c, False, serial, join_blobs(blob)))
                ids = part.column(0)
                head = [W.pack(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)), W.pack(ids.is_null().to_numpy(zero_copy_only=False)), outs, W.pack(np.bincount(t.doc, minlength=part.num_rows))]
                rows.append((serial % places, True, serial, join_blobs(head)))
                kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["place", "head", "slice", "blob"])

    return run


@dataclass
class Pairs:
    """Pairs of token and context of a place, by token and then by context; of texts held out too, with 0 customers."""

    token: np.ndarray  # distinct hashes
    context: np.ndarray  # distinct hashes
    pair_token: np.ndarray  # of each pair, the position of its token
    pair_context: np.ndarray
    customers: np.ndarray  # of each pair, in training texts

    def blob(self) -> bytes:
        return join_blobs([W.pack_sorted(self.token), W.pack(np.bincount(self.pair_token, minlength=len(self.token))), W.pack_sorted(self.context), W.pack(self.pair_context), W.pack(self.customers)])

    @staticmethod
    def of(blob: bytes) -> Pairs:
        w, n, c, i, m = split_blobs(blob)
        token = W.unpack_sorted(w)
        return Pairs(token, W.unpack_sorted(c), np.repeat(np.arange(len(token)), W.unpack(n).astype(np.int64)), W.unpack(i).astype(np.int64), W.unpack(m).astype(np.int64))

    def tables_of_one(self) -> np.ndarray:
        """By context, pairs of one customer, who need no sampling."""
        return np.bincount(self.pair_context, self.customers == 1, minlength=len(self.context)).astype(np.int64)


#: Parts of a state, and whether they ascend.
_PARTS = {
    "hash": True, "word": True, "ones": False, "pairs": False, "parent_opened": False, "parent_openers": False,
    "context": True, "context_hash": True, "context_ones": False,
    "pair": True, "pair_context": False, "customers": False, "opened": False, "openers": False,
}


@dataclass
class State:
    """Seats of a place: words with more than one parent customer, pairs with more than one customer, contexts of these."""

    hash: np.ndarray  # of words
    word: np.ndarray  # position of the word in the place
    ones: np.ndarray  # pairs of one customer of each word
    pairs: np.ndarray  # other pairs of each word
    parent_opened: np.ndarray
    parent_openers: np.ndarray
    context: np.ndarray  # position of the context in the place
    context_hash: np.ndarray
    context_ones: np.ndarray  # pairs of one customer of each context, everywhere
    pair: np.ndarray  # position of the pair in the place
    pair_context: np.ndarray
    customers: np.ndarray
    opened: np.ndarray
    openers: np.ndarray
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # of samples: opened, parent customers, parent tables

    def blob(self) -> bytes:
        parts = [(W.pack_sorted if up else W.pack)(getattr(self, name)) for name, up in _PARTS.items()]
        return join_blobs(parts + [W.pack(x) for sample in self.kept for x in sample])

    @staticmethod
    def of(blob: bytes) -> State:
        blobs = split_blobs(blob)
        hashes = ("hash", "context_hash")
        read = lambda b, up: W.unpack_sorted(b) if up else W.unpack(b)
        parts = {name: x if name in hashes else x.astype(np.int64) for (name, up), b in zip(_PARTS.items(), blobs, strict=False) for x in [read(b, up)]}
        rest = [W.unpack(b).astype(np.int64) for b in blobs[len(_PARTS) :]]
        return State(**parts, kept=[tuple(rest[i : i + 3]) for i in range(0, len(rest), 3)])

    @property
    def pair_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word)), self.pairs)

    def parent(self, opened: np.ndarray) -> np.ndarray:
        """Parent customers of each word: the tables of its pairs."""
        return self.ones + np.bincount(self.pair_word, opened + 1, minlength=len(self.word)).astype(np.int64)

    def by_context(self, opened: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_context, opened + 1, minlength=len(self.context)).astype(np.int64)


def _start(pairs: Pairs, frequent: np.ndarray) -> tuple[State, np.ndarray]:
    """One table for each pair, and sums: tokens, pairs of one and two customers, distinct tokens, parent customers, tables, words of one and two parent customers; by frequent token, its tokens and parent customers."""
    n = len(pairs.token)
    seen = np.bincount(pairs.pair_token, pairs.customers, minlength=n)
    trained = pairs.customers > 0
    ones = np.bincount(pairs.pair_token, pairs.customers == 1, minlength=n).astype(np.int64)
    parent = np.bincount(pairs.pair_token, trained, minlength=n).astype(np.int64)
    often = _is_in(frequent, pairs.token)
    rare = often < 0
    here = rare & (parent > 0)
    sums = [seen.sum(), (pairs.customers == 1).sum(), (pairs.customers == 2).sum(), here.sum(), parent[rare].sum(), here.sum(), (rare & (parent == 1)).sum(), (rare & (parent == 2)).sum()]
    totals = np.zeros((2, len(frequent)))
    totals[:, often[~rare]] = seen[~rare], parent[~rare]
    word = np.flatnonzero(np.where(rare, parent > 1, parent > 0))
    pair = np.flatnonzero(pairs.customers > 1)
    context, pair_context = np.unique(pairs.pair_context[pair], return_inverse=True)
    none, per_word = np.zeros(0, np.int64), np.bincount(pairs.pair_token[pair], minlength=n)
    lonely = np.setdiff1d(pairs.pair_token[pair], word)  # a word of one pair of several customers
    word = np.union1d(word, lonely)
    state = State(
        pairs.token[word], word, ones[word], per_word[word], np.zeros(len(word), np.int64), none,
        context, pairs.context[context], np.zeros(len(context), np.int64),
        pair, pair_context, pairs.customers[pair], np.zeros(len(pair), np.int64), none,
    )
    return state, np.r_[np.array(sums, float), totals.ravel()]


def _gather(frequent: np.ndarray):
    """One row for each place: pairs, entries by slice, heads of slices, the first state and sums."""

    def run(table: pa.Table) -> pa.Table:
        head, which, blobs = table.column("head").to_numpy(), table.column("slice").to_numpy(), table.column("blob")
        order = np.argsort(which, kind="stable")
        heads = [join_blobs([which[i : i + 1].astype("<i8").tobytes(), blobs[int(i)].as_buffer().to_pybytes()]) for i in order if head[i]]
        read = []
        for i in order[~head[order]]:
            w, n, c, index, n_entries, doc, count, held = split_blobs(blobs[int(i)].as_py())
            size = W.unpack(n_entries).astype(np.int64) + 1
            out = W.unpack(held).astype(bool)[W.unpack(doc).astype(np.int64)]
            customers = np.add.reduceat(np.where(out, 0, W.unpack(count).astype(np.int64) + 1), np.cumsum(size) - size)
            read.append((W.unpack_sorted(w), W.unpack(n).astype(np.int64), W.unpack_sorted(c), W.unpack(index).astype(np.int64), customers))
        if read:
            token, context = np.unique(np.concatenate([r[0] for r in read])), np.unique(np.concatenate([r[2] for r in read]))
            keys = [np.repeat(np.searchsorted(token, w), n) * len(context) + np.searchsorted(context, c)[index] for w, n, c, index, _ in read]
            every = np.concatenate(keys)
            order_ = np.argsort(every)
            every = every[order_]
            new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            customers = np.add.reduceat(np.concatenate([r[4] for r in read])[order_], new)
            key = every[new]
            pairs = Pairs(token, context, key // len(context), key % len(context), customers)
        else:
            none = np.zeros(0, np.int64)
            pairs, key, keys = Pairs(np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none), none, []
        state, sums = _start(pairs, frequent)
        entries = []
        for i, k in zip(order[~head[order]], keys, strict=True):
            *_, n_entries, doc, count, held = split_blobs(blobs[int(i)].as_py())
            entries.append(join_blobs([which[i : i + 1].astype("<i8").tobytes(), W.pack_sorted(np.searchsorted(key, k)), n_entries, doc, count, held]))
        row = {"pairs": pairs.blob(), "entries": join_blobs(entries), "heads": join_blobs(heads), "state": state.blob(), "sums": sums.tobytes()}
        return pa.table({"place": pa.array([table.column("place")[0].as_py()], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in row.items()})

    return run


# What places and owners of restaurants tell each other


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = {"kind": pa.int32(), "place": pa.int32(), "key": pa.int32(), "blob": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def _messages(place: int, contexts: np.ndarray, values: list[np.ndarray], places: int) -> list[tuple[int, int, int, bytes]]:
    """Values by context (ascending), for the contexts' owners."""
    n = owners(places)
    cut = np.searchsorted(_at(contexts, n), np.arange(n + 1))
    return [(MESSAGE, place, o, join_blobs([W.pack_sorted(contexts[a:b]), *[W.pack(v[a:b]) for v in values]])) for o, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]


def _owner(table: pa.Table) -> pa.Table:
    """The sums of what all places say of an owner's contexts, to each place for those that it named."""
    places, owner = table.column("place").to_pylist(), table.column("key")[0].as_py()
    said = [split_blobs(b.as_py()) for b in table.column("blob")]
    contexts = [W.unpack_sorted(x[0]) for x in said]
    every = np.unique(np.concatenate(contexts))
    at = [np.searchsorted(every, c) for c in contexts]
    totals = np.zeros((len(said[0]) - 1, len(every)))
    for i, x in zip(at, said, strict=True):
        totals[:, i] += np.stack([W.unpack(v).astype(float) for v in x[1:]])
    return _table([(REPLY, p, owner, join_blobs([W.pack(v) for v in totals[:, i]])) for p, i in zip(places, at, strict=True)])


def _exchange(messages: DataFrame) -> DataFrame:
    return messages.groupBy("key").applyInArrow(_owner, _ROWS)


def _of_kind(table: pa.Table, kind: int) -> list[bytes]:
    """Blobs of a kind, in the order of their keys."""
    kinds, keys, blobs = table.column("kind").to_numpy(), table.column("key").to_numpy(), table.column("blob")
    at = np.flatnonzero(kinds == kind)
    return [blobs[int(i)].as_py() for i in at[np.argsort(keys[at], kind="stable")]]


def _replies(table: pa.Table) -> list[np.ndarray]:
    """Values by context of the place: owners' ranges ascend."""
    parts = [[W.unpack(v).astype(np.int64) for v in split_blobs(b)] for b in _of_kind(table, REPLY)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


# Sweeps


@dataclass
class Totals:
    """What all places share after a sweep; vectors over the frequent tokens."""

    n: float  # training tokens
    v: float  # distinct training tokens
    seen: np.ndarray  # training count of each frequent token
    parent: np.ndarray  # parent customers of each frequent token
    opened: np.ndarray  # their parent tables after the first
    openers: np.ndarray
    rare_n: float  # parent customers and tables of all other tokens
    rare_t: float
    discount: float
    parent_discount: float
    strength: float

    @property
    def tables(self) -> np.ndarray:
        return np.where(self.parent > 0, self.opened + 1, 0)

    @property
    def base(self) -> float:
        return 1.0 / (self.v + 1)

    @property
    def parent_tables(self) -> float:
        return self.rare_t + self.tables.sum()

    def unigram(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        back = (self.strength + self.parent_discount * self.parent_tables) * self.base
        return (np.maximum(customers - self.parent_discount * tables, 0) + back) / (self.strength + self.rare_n + self.parent.sum())

    def bigram(self, customers: np.ndarray, tables: np.ndarray, of_context: np.ndarray, tables_of_context: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        back = (self.strength + self.discount * tables_of_context) * unigram
        return (np.maximum(customers - self.discount * tables, 0) + back) / (self.strength + of_context)

    def reseat_parents(self, customers: np.ndarray, opened: np.ndarray, openers: np.ndarray, hashes: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.strength + self.parent_discount * (self.parent_tables - opened - 1)
        return reseat(customers, opened, openers, a, np.full(len(customers), self.base), self.parent_discount, W.mix(hashes ^ _GOLDEN), sweep)


def _or_frequent(own: np.ndarray, often: np.ndarray, of_frequent: np.ndarray) -> np.ndarray:
    return np.where(often >= 0, of_frequent[np.maximum(often, 0)], own) if len(of_frequent) else own


def _sweep(shared, sweep: int, keep: bool, places: int):
    """Seats a place anew: its state, its tables by context for their owners, and sums."""

    def run(table: pa.Table) -> pa.Table:
        frequent, totals = shared.value
        place, state = table.column("place")[0].as_py(), State.of(_of_kind(table, STATE)[0])
        replies = _replies(table)
        if len(replies) == 3:  # the first are on all contexts of the place
            state.context_ones, of_context = replies[1][state.context], replies[1][state.context] + replies[2][state.context]
        else:
            of_context = state.context_ones + (replies[0] if replies else 0)
        often = _is_in(frequent, state.hash)
        rare = often < 0
        parent = _or_frequent(state.parent(state.opened), often, totals.parent)
        unigram = totals.unigram(parent, _or_frequent(state.parent_opened + 1, often, totals.tables))
        word, context = state.pair_word, state.pair_context
        before = state.opened
        a = totals.strength + totals.discount * (of_context[context] - before - 1)
        key = W.mix(state.hash[word] + W.mix(state.context_hash[context]))
        state.opened, state.openers = reseat(state.customers, before, state.openers, a, unigram[word], totals.discount, key, sweep)
        parent = state.parent(state.opened)
        old = np.where(rare, state.parent_opened, 0)
        opened, openers = totals.reseat_parents(np.where(rare, parent, 1), old, state.parent_openers, state.hash, sweep)
        # words that aren't in the state stay as they are: change sums by differences
        sums = np.array([(parent - state.parent(before))[rare].sum(), (opened - state.parent_opened)[rare].sum()], float)
        state.parent_opened, state.parent_openers = opened, openers
        of_frequent = np.zeros(len(frequent))
        of_frequent[often[~rare]] = parent[~rare]
        if keep:
            state.kept.append((state.opened, parent, opened + 1))
        rows = [(STATE, place, -1, state.blob()), (SUMS, place, -1, np.r_[sums, of_frequent].tobytes())]
        return _table(rows + _messages(place, state.context_hash, [state.by_context(state.opened)], places))

    return run


def _add(table: pa.Table) -> pa.Table:
    return pa.table({"total": pa.array([sum(np.frombuffer(x) for x in table.column("total").to_pylist()).tobytes()], pa.binary())})


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors of (place, total)."""
    few = rows.select(F.pmod("place", F.lit(16)).alias("g"), "total").groupBy("g").applyInArrow(_add, "total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in few), np.zeros(size))


class Model:
    """The places, their seats after the last sweep, and the totals of each sample that is averaged."""

    def __init__(self, table: DataFrame, state: DataFrame, frequent: np.ndarray, kept: list[Totals], places: int):
        self.table, self.state, self.frequent, self.kept, self.places = table, state, frequent, kept, places


def _as_rows(table: DataFrame, kind: int, column: str) -> DataFrame:
    return table.select(F.lit(kind).cast("int").alias("kind"), "place", F.lit(-1).cast("int").alias("key"), F.col(column).alias("blob"))


def fit(docs: DataFrame, held_out: str, sweeps: int = 4, burn_in: int = 1, strength: float = 1.0, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Seat all texts whose boolean column `held_out` is false, in `sweeps` sweeps; the first `burn_in` aren't averaged.

    Every token and every context counts, whatever its frequency.  Discounts come from the counts of one
    and of two; the strength is the same at both levels.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("some sweep must come after the burn-in")
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(held_out).cast("boolean").alias("held"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a token of twice the share has the share in some slice, and in the sum over slices
    share = 1 / (8 * partitions)
    counted = written(rows.mapInArrow(_frequent_here(share), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    n_all = (counted.filter("token is null").agg(F.sum("n")).first()[0]) or 0
    top = counted.filter(F.col("token").isNotNull() & (F.col("n") >= share * n_all)).select("token").collect()  # 8 for each partition at most
    discard(counted)
    frequent = np.sort(np.array([r["token"] for r in top], np.int64).view(np.uint64))
    places = max(partitions, -(-n_all // PLACE))
    dealt = rows.mapInArrow(_deal(frequent, places), "place int, head boolean, slice long, blob binary")
    table = written(dealt.groupBy("place").applyInArrow(_gather(frequent), "place int, pairs binary, entries binary, heads binary, state binary, sums binary"))

    x = _summed(table.select("place", F.col("sums").alias("total")), 8 + 2 * len(frequent))
    n, one, two, v, rare_n, rare_t, p_one, p_two = x[:8]
    seen, parent = x[8:].reshape(2, -1)
    none = np.zeros(0, np.int64)
    discount, parent_discount = (one + 1) / (one + 2 * two + 2), (p_one + 1) / (p_one + 2 * p_two + 2)
    totals = Totals(n, v + (seen > 0).sum(), seen, parent.astype(np.int64), np.zeros(len(frequent), np.int64), none, rare_n, rare_t, discount, parent_discount, strength)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = Pairs.of(blob.as_py())
                values = [np.bincount(pairs.pair_context, w, minlength=len(pairs.context)).astype(np.int64) for w in (pairs.customers, pairs.customers == 1, pairs.customers > 1)]
                yield from _table(_messages(place, pairs.context, values, places)).to_batches()

    state = _as_rows(table, STATE, "state")
    replies = _exchange(table.select("place", "pairs").mapInArrow(ask, _ROWS))
    kept, before = [], None
    for s in range(sweeps):
        shared = sc.broadcast((frequent, totals))  # 8 tokens for each partition at most
        out = written(state.union(replies).groupBy("place").applyInArrow(_sweep(shared, s, s >= burn_in, places), _ROWS))
        x = _summed(out.filter(F.col("kind") == SUMS).select("place", F.col("blob").alias("total")), 2 + len(frequent))
        parent = x[2:].astype(np.int64)
        opened, openers = totals.reseat_parents(np.maximum(parent, 1), totals.opened, totals.openers, frequent, s)
        totals = Totals(n, totals.v, seen, parent, opened, openers, totals.rare_n + x[0], totals.rare_t + x[1], discount, parent_discount, strength)
        if s >= burn_in:
            kept.append(totals)
        if before is not None:
            discard(before)
        before = out
        state = out.filter(F.col("kind") == STATE)
        replies = _exchange(out.filter(F.col("kind") == MESSAGE))
    return Model(table, state, frequent, kept, places)


# Scoring


def _ask_all(samples: int, places: int):
    """Of all contexts of a place: customers, pairs of one customer, and other pairs' tables in each sample."""

    def run(table: pa.Table) -> pa.Table:
        pairs, state = Pairs.of(_of_kind(table, PAIRS)[0]), State.of(_of_kind(table, STATE)[0])
        customers = np.bincount(pairs.pair_context, pairs.customers, minlength=len(pairs.context)).astype(np.int64)
        values = [customers, pairs.tables_of_one()]
        for opened, _, _ in state.kept[:samples]:
            of = np.zeros(len(pairs.context), np.int64)
            of[state.context] = state.by_context(opened)
            values.append(of)
        return _table(_messages(table.column("place")[0].as_py(), pairs.context, values, places))

    return run


def predictive(pairs: Pairs, state: State, replies: list[np.ndarray], frequent: np.ndarray, kept: list[Totals]) -> np.ndarray:
    """The probability of each pair's token after its context, averaged over the samples."""
    often = _is_in(frequent, pairs.token)
    trained = np.bincount(pairs.pair_token, pairs.customers > 0, minlength=len(pairs.token)) > 0
    total = np.zeros(len(pairs.customers))
    for s, totals in enumerate(kept):
        opened, of_word, tables_of_word = state.kept[s]
        tables = (pairs.customers > 0).astype(np.int64)
        tables[state.pair] += opened
        parent, parent_tables = trained.astype(np.int64), trained.astype(np.int64)
        parent[state.word], parent_tables[state.word] = of_word, tables_of_word
        parent, parent_tables = _or_frequent(parent, often, totals.parent), _or_frequent(parent_tables, often, totals.tables)
        unigram = totals.unigram(parent, parent_tables)
        of_context = replies[1] + replies[2 + s]
        total += totals.bigram(pairs.customers, tables, replies[0][pairs.pair_context], of_context[pairs.pair_context], unigram[pairs.pair_token])
    return total / len(kept)


def _score(shared):
    """Sums by slice: logs of averaged probabilities, logs of counts plus one, known tokens."""

    def run(table: pa.Table) -> pa.Table:
        frequent, kept = shared.value
        pairs, state = Pairs.of(_of_kind(table, PAIRS)[0]), State.of(_of_kind(table, STATE)[0])
        out = []
        for head in split_blobs(_of_kind(table, HEADS)[0]):
            which, blob = split_blobs(head)
            out.append((int(np.frombuffer(which, "<i8")[0]), True, blob))
        if len(pairs.token):
            p = predictive(pairs, state, _replies(table), frequent, kept)
            c = _or_frequent(np.bincount(pairs.pair_token, pairs.customers, minlength=len(pairs.token)), _is_in(frequent, pairs.token), kept[0].seen)
            values = np.rint(-np.log10(p) / UNIT), np.rint(np.log10(c + 1) / UNIT)[pairs.pair_token], (c > 0)[pairs.pair_token].astype(float)
            for entries in split_blobs(_of_kind(table, ENTRIES)[0]):
                which, pair, n, doc, count, held = split_blobs(entries)
                n = W.unpack(n).astype(np.int64) + 1
                pair, doc, count = np.repeat(W.unpack_sorted(pair).astype(np.int64), n), W.unpack(doc).astype(np.int64), W.unpack(count).astype(float) + 1
                has, doc = np.unique(doc, return_inverse=True)
                sums = [W.pack(np.bincount(doc, count * v[pair])) for v in values]  # whole numbers
                out.append((int(np.frombuffer(which, "<i8")[0]), False, join_blobs([W.pack_sorted(has), *sums])))
        kinds = {"slice": pa.int64(), "head": pa.bool_(), "blob": pa.binary()}
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())})

    return run


def _add_up(table: pa.Table) -> pa.Table:
    rows = list(zip(table.column("head").to_pylist(), table.column("blob").to_pylist(), strict=True))
    ids, null, held, n = (W.unpack(x) for x in split_blobs(next(b for h, b in rows if h)))
    sums = np.zeros((3, len(ids)))
    for head, blob in rows:
        if not head:
            has, *values = split_blobs(blob)
            sums[:, W.unpack_sorted(has).astype(np.int64)] += np.stack([W.unpack(x).astype(float) for x in values])
    return pa.table(
        {
            "doc_id": pa.array(ids.view(np.int64), mask=null.astype(bool)),
            "held_out": pa.array(held.astype(bool)),
            "n_tokens": pa.array(n.astype(np.int64)),
            "n_known": pa.array(sums[2].astype(np.int64)),
            "log_counts": pa.array(sums[1] * UNIT),
            "score": pa.array(-sums[0] * UNIT),
        }
    )


def score(model: Model) -> DataFrame:
    """Scores of all texts that went into the fit, held out or not: a row for each row.

    doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10 under
    counts plus one), score (log10 of the text under the predictive probabilities averaged over the
    sweeps after the burn-in) and perplexity (10 ** (-score / n_tokens)).

    A null or empty text is its end only.  Without training texts every token has probability 1 / 1
    under both.  Repeated rows score alike and each counts in training; null ids are treated as the empty
    text by the caller's held_out column.  Other columns are ignored; an empty table gives no rows.
    """
    sc = model.table.sparkSession.sparkContext
    shared = sc.broadcast((model.frequent, model.kept))
    pairs = _as_rows(model.table, PAIRS, "pairs")
    replies = written(_exchange(pairs.union(model.state).groupBy("place").applyInArrow(_ask_all(len(model.kept), model.places), _ROWS)))
    parts = pairs.union(_as_rows(model.table, ENTRIES, "entries")).union(_as_rows(model.table, HEADS, "heads")).union(model.state).union(replies)
    sums = parts.groupBy("place").applyInArrow(_score(shared), "slice long, head boolean, blob binary")
    texts = sums.groupBy("slice").applyInArrow(_add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    start = model.kept[0]
    base = F.col("log_counts") - F.col("n_tokens") * float(np.log10(start.n + start.v + 1))
    return texts.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(start.n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )


def language_model(docs: DataFrame, held_out_mod: int = 7, held_out_is: int = 2) -> DataFrame:
    """Fit on the documents whose crc32(doc_id as text) modulo `held_out_mod` isn't `held_out_is`, and score all."""
    held = docs.select("doc_id", "text", (remainder(F.col("doc_id"), held_out_mod) == held_out_is).alias("held_out"))
    return score(fit(held, "held_out"))
