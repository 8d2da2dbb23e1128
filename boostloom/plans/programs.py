"""Programs over all hypotheses, as boosters use them: over groups of equal margins, or over rows.

Over rows nothing but sums reaches the driver.  Each program is the least over distributions d in the capped simplex of a
convex function of the edges; its dual has a variable for each hypothesis and one for the sum of d, and given these a row's d is

    min(1/nu, exp(eta (theta - base - sum_j v_j m_j) - 1) / m),

a Column (for the linear program: 1/nu by the logistic function of the same height, which is smooth at both ends).  One aggregate gives the dual's value, its gradient (the edges) and its second derivatives (products of margins
under the rows that aren't capped), and the values at shorter steps along the way; the driver solves a quadratic
program in as many variables as there are hypotheses in use and moves on (Newton's method, some ten aggregates a program).
The linear program is the limit for large eta: eta grows until the gap between the largest edge and the dual's value, a lower bound, is small enough.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.functions.projection import capped
from boostloom.lineage import cut
from boostloom.operators.base import Classifier, Prepared
from boostloom.operators.combined import _sum
from boostloom.plans import solvers
from boostloom.plans.groups import MarginGroups, TooManyGroups
from boostloom.sources.sample import TARGET

#: Lengths of the shorter steps whose values an aggregate gives beside the full one's.
SHORTER = (0.5, 0.2, 0.05, 0.01, 0.001)


def _double(x: float) -> str:
    return f"({float(x)!r}D)"


@dataclass
class Look:
    """What one aggregate says of the dual at a point."""

    value: float  #: of the dual
    total: float  #: sum of d
    edges: np.ndarray  #: sum of d times each column
    divergence: float  #: sum of d ln(m d)
    offset: float  #: sum of d times base
    live: float  #: sum of d over rows that aren't capped (logistic: of d (1 - nu d)): the curvature by eta
    live_edges: np.ndarray
    live_products: np.ndarray
    shorter: list[float]  #: values at the shorter steps

    def primal_divergence(self) -> float:
        """Of d divided by its sum."""
        return self.divergence / self.total - math.log(self.total)


class Dual:
    """Greatest over v and theta of theta + slope v - sum of the rows' conjugates, where v is in the simplex, not negative or in [0, most].

    `columns` are the rows' coefficients of v, `base` their constants, n the examples that a row stands for.
    """

    #: Variables that move in one step, at most; others wait for the next.
    WORKING = 24

    def __init__(self, rows: DataFrame, columns: list[Column], base: Column | None, eta: float, nu: float, m: float, slope: float = 0.0, domain: str | float = "simplex", logistic: bool = False):
        base = F.lit(0.0) if base is None else base
        self.rows = rows.select(F.col("n").cast("double").alias("n"), base.cast("double").alias("b"), *[c.cast("double").alias(f"z{j}") for j, c in enumerate(columns)])
        self.t, self.eta, self.nu, self.m, self.slope, self.domain = len(columns), eta, nu, float(m), slope, domain
        self.logistic, self.looks = logistic, 0

    def _height(self, k: int) -> str:
        """Of the k-th point among the parameters `p`."""
        at = k * (self.t + 1)
        return " - ".join([f"p[{at}]", "b", *[f"p[{at + 1 + j}] * z{j}" for j in range(self.t)]])

    @staticmethod
    def share(height: str, eta: float, nu: float, m: float, logistic: bool = False) -> str:
        """d of a row, in SQL."""
        if logistic:
            return f"{_double(1 / nu)} / (1D + exp({_double(-eta)} * ({height})))"
        log = f"({_double(eta)} * ({height}) - {_double(1 + math.log(m))})"
        return f"CASE WHEN {log} >= {_double(-math.log(nu))} THEN {_double(1 / nu)} ELSE exp({log}) END"

    def _conjugate(self, height: str) -> str:
        eta, cap = _double(self.eta), _double(1 / self.nu)
        if self.logistic:
            return f"-(greatest({eta} * ({height}), 0D) + log1p(exp(-abs({eta} * ({height}))))) * {cap} / {eta}"
        log = f"({eta} * ({height}) - {_double(1 + math.log(self.m))})"
        flat = f"{cap} * ({_double(math.log(self.m / self.nu) / self.eta)} - ({height}))"
        return f"CASE WHEN {log} >= {_double(-math.log(self.nu))} THEN {flat} ELSE -exp({log}) / {eta} END"

    def look(self, v: np.ndarray, theta: float, working: list[int], near: list[tuple[np.ndarray, float]] = ()) -> Look:
        """One aggregate at (v, theta); second derivatives for the working variables, values alone for the points nearby."""
        self.looks += 1
        points = [x for w, y in [(v, theta), *near] for x in (y, *w)]
        # one row with the points, a column and not literals: generated code is the same for every look, and compiled once
        given = self.rows.sparkSession.range(1, numPartitions=1).selectExpr(f"array({', '.join(map(_double, points))}) AS p")
        at = self.rows.join(F.broadcast(given)).selectExpr("*", f"{self._height(0)} AS u", *[f"{self._height(i + 1)} AS u{i}" for i in range(len(near))])
        at = at.selectExpr("*", f"{self.share('u', self.eta, self.nu, self.m, self.logistic)} AS s")
        bends = f"s * (1D - s * {_double(self.nu)})" if self.logistic else f"CASE WHEN s < {_double(1 / self.nu)} THEN s ELSE 0D END"
        at = at.selectExpr("*", "n * s AS d", f"n * ({bends}) AS live")
        sums = [f"sum(n * ({self._conjugate('u')})) AS q", "sum(d) AS s", f"sum(CASE WHEN s > 0 THEN d * ln(s * {_double(self.m)}) ELSE 0D END) AS k", "sum(d * b) AS o", "sum(live) AS l"]
        sums += [f"sum(d * z{j}) AS e{j}" for j in range(self.t)] + [f"sum(live * z{j}) AS l{j}" for j in working]
        sums += [f"sum(live * z{j} * z{k}) AS p{j}_{k}" for i, j in enumerate(working) for k in working[i:]]
        sums += [f"sum(n * ({self._conjugate(f'u{i}')})) AS t{i}" for i in range(len(near))]
        r = at.selectExpr(*sums).first()
        products = np.zeros((len(working), len(working)))
        for i, j in enumerate(working):
            for k in range(i, len(working)):
                products[i, k] = products[k, i] = r[f"p{j}_{working[k]}"]
        edges = np.array([r[f"e{j}"] for j in range(self.t)], float)
        shorter = [y + self.slope * float(np.sum(x)) + r[f"t{i}"] for i, (x, y) in enumerate(near)]
        value = theta + self.slope * float(np.sum(v)) + r["q"]
        return Look(value, r["s"], edges, r["k"], r["o"], r["l"], np.array([r[f"l{j}"] for j in working]), products, shorter)

    def _working(self, v: np.ndarray, edges: np.ndarray) -> list[int]:
        """Variables in use, and those of the largest edges."""
        if self.t <= self.WORKING:
            return list(range(self.t))
        used = sorted(np.flatnonzero(v > 0), key=lambda j: -v[j])[: self.WORKING - 8]
        rest = [int(j) for j in np.argsort(-edges) if j not in set(used)]
        return sorted([int(j) for j in used] + rest[: self.WORKING - len(used)])

    def _step(self, look: Look, v: np.ndarray, working: list[int]) -> tuple[np.ndarray, float]:
        """The greatest point of the quadratic model; theta's part follows from v's."""
        live = max(look.live, 1e-9)
        mean = look.live_edges / live
        ascent = look.edges[working] + self.slope + (1.0 - look.total) * mean
        curve = self.eta * (look.live_products - live * np.outer(mean, mean))
        x = best_quadratic(curve, ascent, v[working], self.domain) if working else np.zeros(0)
        move = x - v[working] if working else x
        to = v.copy()
        to[working] = x
        drift = (1.0 - look.total) / (self.eta * live)
        return to, float(np.clip(drift, -3 / self.eta, 3 / self.eta)) + float(mean @ move)

    def ascend(self, v: np.ndarray, theta: float, done, rounds: int = 100) -> tuple[np.ndarray, float, Look]:
        """Newton's method from (v, theta) until done(v, look), or until no step gains anything."""
        working = self._working(v, np.zeros(self.t))
        look = self.look(v, theta, working)
        for _ in range(rounds):
            if done(v, look):
                break
            to, drift = self._step(look, v, working)
            near = [(v + s * (to - v), theta + s * drift) for s in SHORTER]
            after = self.look(to, theta + drift, working, near)
            values, scale = [after.value, *after.shorter], max(1.0, abs(look.value))
            # where values differ by rounding only, the whole step is as good as any and ends the search
            best = 0 if after.value >= max(values) - 1e-13 * scale else int(np.argmax(values))
            gain = values[best] - look.value
            if not gain > 1e-15 * scale and not (best == 0 and done(to, after)):
                break
            v, theta = (to, theta + drift) if best == 0 else near[best - 1]
            chosen = self._working(v, after.edges)
            if best == 0 and chosen == working:
                look = after
            else:
                working = chosen
                look = self.look(v, theta, working)
        return v, theta, look


class CellDual(Dual):
    """The linear program's dual over cells of rows with nearly equal margins, on the driver: (n, b, z0, z1, ...), n in all and means."""

    #: Cells at most, and their numbers to a unit of margin, the first that gives no more.
    MOST, FINE = 50_000, (512, 128, 32, 8)

    def __init__(self, cells: np.ndarray, eta: float, nu: float, m: float):
        self.n, self.b, self.z = cells[:, 0], cells[:, 1], cells[:, 2:]
        self.t, self.eta, self.nu, self.m, self.slope, self.domain = self.z.shape[1], eta, nu, float(m), 0.0, "simplex"
        self.logistic, self.looks = True, 0

    @staticmethod
    def of(rows: DataFrame) -> tuple[np.ndarray, int] | None:
        """The cells of a Dual's rows and their number to a unit; None if they are too many however coarse."""
        names = [c for c in rows.columns if c != "n"]
        cell = lambda fine: [F.floor(F.col(c) * fine) for c in names]
        counts = rows.agg(*[F.approx_count_distinct(F.xxhash64(*cell(k))) for k in CellDual.FINE]).first()
        fine = next((k for k, n in zip(CellDual.FINE, counts, strict=True) if n <= CellDual.MOST), None)
        if fine is None:
            return None
        means = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in names]
        table = rows.groupBy(*[x.alias(f"c{i}") for i, x in enumerate(cell(fine))]).agg(F.sum("n").alias("n"), *means)
        return table.select("n", *names).toPandas().to_numpy(float), fine

    def look(self, v: np.ndarray, theta: float, working: list[int], near: list[tuple[np.ndarray, float]] = ()) -> Look:
        self.looks += 1
        height = lambda v, theta: self.eta * (theta - self.b - self.z @ v)
        conjugate = lambda v, theta: -float(self.n @ np.logaddexp(0.0, height(v, theta))) / (self.nu * self.eta)
        log = -math.log(self.nu) - np.logaddexp(0.0, -height(v, theta))
        s = np.exp(log)
        d = self.n * s
        live = d * (1.0 - s * self.nu)
        z = self.z[:, working]
        shorter = [y + conjugate(x, y) for x, y in near]
        return Look(theta + conjugate(v, theta), float(d.sum()), self.z.T @ d, float(d @ (log + math.log(self.m))), float(d @ self.b), float(live.sum()), z.T @ live, (z.T * live) @ z, shorter)


def best_quadratic(curve: np.ndarray, ascent: np.ndarray, v: np.ndarray, domain: str | float, rounds: int = 60) -> np.ndarray:
    """The x with the greatest ascent (x - v) - (x - v) curve (x - v) / 2, by an interior-point method.

    x is in the probability simplex, not negative ("nonnegative"), or, one variable only, in [0, domain].
    """
    t = len(v)
    scale = max(float(np.trace(curve)) / t, float(np.abs(ascent).max()), 1e-300)
    a = curve / scale + 1e-10 * np.eye(t)
    if not isinstance(domain, str):
        return np.clip(v + ascent / scale / a[0, 0], 0.0, domain)
    q = ascent / scale + a @ v
    simplex = domain == "simplex"
    x = np.full(t, 1.0 / t) if simplex else np.maximum(v, 0.1)
    y = 0.0
    s = np.full(t, max(1.0, float(np.abs(a @ x - q).max())))
    for _ in range(rounds):
        mu = float(x @ s) / t
        dual = a @ x - q - s - (y if simplex else 0.0)
        primal = float(x.sum() - 1.0) if simplex else 0.0
        if mu < 1e-16 and np.abs(dual).max() < 1e-13 and abs(primal) < 1e-13:
            break
        h = a + np.diag(s / x)
        rhs = -dual - s + 0.1 * mu / x
        if simplex:
            kkt = np.block([[h, -np.ones((t, 1))], [np.ones((1, t)), np.zeros((1, 1))]])
            both = np.linalg.solve(kkt, np.r_[rhs, -primal])
            dx, dy = both[:t], both[t]
        else:
            dx, dy = np.linalg.solve(h, rhs), 0.0
        ds = (0.1 * mu - s * dx) / x - s
        most = lambda p, dp: min([1.0, *(0.995 * -p[dp < 0] / dp[dp < 0])])
        step = min(most(x, dx), most(s, ds))
        x, y, s = x + step * dx, y + step * dy, s + step * ds
    x = np.where((x < s) & (x < 1e-9), 0.0, x)
    return x / x.sum() if simplex else x


class Programs(ABC):
    """The hypotheses so far, a distribution over the rows, and the programs that set it.

    Values are of examples' margins; nu is the capping parameter, eta the weight of edges against the divergence.
    """

    #: Of the present distribution, by hypothesis; and from the uniform one.
    edges: np.ndarray
    divergence: float

    @abstractmethod
    def add(self, h: Classifier) -> None:
        """One more hypothesis."""

    @abstractmethod
    def soft_margin(self, nu: float, gap: float) -> tuple[float, np.ndarray]:
        """(value, weights) of the largest soft margin, within `gap`."""

    @abstractmethod
    def least_divergence(self, nu: float, bound: float) -> bool:
        """Set the distribution of least divergence whose edges are at most `bound`; False if there is none."""

    @abstractmethod
    def entropy(self, nu: float, eta: float, w: np.ndarray | None) -> tuple[float, np.ndarray]:
        """(value, weights) of the least of the largest edge and divergence / eta together."""

    @abstractmethod
    def smooth(self, w: np.ndarray, nu: float, eta: float) -> float:
        """The smoothed soft margin of weights w; sets the distribution in which it is taken."""

    @abstractmethod
    def weight(self) -> Column:
        """An example's weight in the present distribution."""

    @abstractmethod
    def widest(self, direction: np.ndarray) -> float:
        """The largest change of a row's margin in a direction of weights."""

    @abstractmethod
    def search(self, w: np.ndarray, direction: np.ndarray, most: float, nu: float, eta: float) -> float:
        """The step in [0, most] with the largest smoothed soft margin."""


class GroupPrograms(Programs):
    """Over groups of rows with equal margins, solved on the driver: quick where margins take few values."""

    def __init__(self, train: Prepared, most: int = 100_000):
        self.groups = MarginGroups(train, most)
        self.d = np.full(len(self.groups.keys), 1.0 / self.groups.number.sum())
        self.edges, self.divergence = np.zeros(0), 0.0

    def add(self, h: Classifier) -> None:
        self.groups.add(h)

    def _set(self, d: np.ndarray) -> None:
        self.d = d
        self.edges = self.groups.margins.T @ (self.groups.number * d)
        self.divergence = solvers.divergence(d, self.groups.number)

    def soft_margin(self, nu: float, gap: float) -> tuple[float, np.ndarray]:
        value, w, d = solvers.soft_margin_lp(self.groups.margins, self.groups.number, nu)
        self._set(d)
        return value, w

    def least_divergence(self, nu: float, bound: float) -> bool:
        d = solvers.least_divergence(self.groups.margins, self.groups.number, nu, bound)
        if d is not None:
            self._set(d)
        return d is not None

    def entropy(self, nu: float, eta: float, w: np.ndarray | None) -> tuple[float, np.ndarray]:
        value, w, d = solvers.entropy_program(self.groups.margins, self.groups.number, nu, eta, w)
        self._set(d)
        return value, w

    def _at(self, w: np.ndarray, nu: float, eta: float) -> np.ndarray:
        return capped(-eta * (self.groups.margins @ w), self.groups.number, 1.0 / nu)

    def smooth(self, w: np.ndarray, nu: float, eta: float) -> float:
        self._set(self._at(w, nu, eta))
        return float(self.edges @ w) + self.divergence / eta

    def weight(self) -> Column:
        return self.groups.weight(self.d)

    def widest(self, direction: np.ndarray) -> float:
        return float(np.abs(self.groups.margins @ direction).max())

    def search(self, w: np.ndarray, direction: np.ndarray, most: float, nu: float, eta: float) -> float:
        along = self.groups.margins @ direction
        slope = lambda s: float((self.groups.number * self._at(w + s * direction, nu, eta)) @ along)
        return solvers.sign_change(slope, most)


class RowPrograms(Programs):
    """Over rows: each hypothesis' margins are a column, each program some tens of aggregates.

    `gap` bounds a program's duality gap (entropy programs) or how far an edge may be over its bound (least divergence).
    `noise` is added to every row's margin in soft_margin().
    """

    def __init__(self, train: Prepared, hypotheses: list[Classifier] = (), gap: float = 1e-6):
        self.train, self.m, self.gap = train, float(train.m), gap
        self.hypotheses: list[Classifier] = []
        self.noise: Column | None = None
        self.edges, self.divergence = np.zeros(0), 0.0
        self._point: tuple | None = None
        self._kept = train.df
        for h in hypotheses:
            self.add(h)

    def add(self, h: Classifier) -> None:
        rows = self.train.df.drop("__u").withColumn(f"__m{len(self.hypotheses)}", F.col(TARGET) * h.confidence(self.train.binned))
        before, self._kept = self._kept, cut(rows)
        self._kept.count()  # cached before the rows that it was made from are let go
        before.unpersist()
        self.train.df = self._kept
        self.hypotheses.append(h)

    def _columns(self) -> list[Column]:
        return [F.col(f"__m{j}") for j in range(len(self.hypotheses))]

    def _dual(self, eta: float, nu: float, **kw) -> Dual:
        return Dual(self.train.df, kw.pop("columns", self._columns()), kw.pop("base", None), eta, nu, self.m, **kw)

    def _start(self, eta: float, nu: float, theta: float | None, before: float | None) -> float:
        """Theta for a new eta: what was capped stays so."""
        edge = lambda e: (1.0 + math.log(self.m / nu)) / e
        return 1.0 / eta if theta is None else theta - edge(before) + edge(eta)

    @staticmethod
    def _stages(eta: float, factor: float = 6.0) -> list[float]:
        """Growing values up to eta."""
        out = [eta]
        while out[0] > 12.0:
            out.insert(0, out[0] / factor)
        return out

    def _set(self, v: np.ndarray, theta: float, eta: float, nu: float, base: Column | None, look: Look, logistic: bool = False) -> None:
        self._point = (v, theta, eta, nu, base, logistic)
        self.edges = look.edges / look.total
        self.divergence = look.primal_divergence()

    def _path(self, eta: float, nu: float, v: np.ndarray, finish) -> tuple[np.ndarray, float, Look]:
        """Solve for growing eta up to the wanted one, each from the solution before; all but the last roughly."""
        spread = max(math.log(self.m / nu), 0.1)
        theta = before = None
        for e in self._stages(eta):
            rough = lambda v, look, e=e: abs(1 - look.total) < 0.05 and (look.edges.max() - v @ look.edges) / look.total < 0.1 * spread / e
            v, theta, look = self._dual(e, nu).ascend(v, self._start(e, nu, theta, before), finish if e == eta else rough)
            before = e
        return v, theta, look

    @staticmethod
    def _even(look: Look) -> bool:
        return abs(1.0 - look.total) < 1e-7

    def soft_margin(self, nu: float, gap: float) -> tuple[float, np.ndarray]:
        """The weights' soft margin is at least the value less `gap`; the value is the largest edge (and the noise, if any) in the distribution.

        The program is solved over cells of rows first. Its solution is a place to start from only: the gap is that over the rows,
        and if it isn't closed from there, the rows go the whole way.
        """
        v = np.full(len(self.hypotheses), 1.0 / len(self.hypotheses))
        share = min(nu / self.m, 1.0)
        spread = (-math.log(share) - (1 - share) / share * math.log1p(-share)) if share < 1 else 0.1  # what the smoothing takes off, times eta
        primal = lambda look: (look.edges.max() + look.offset) / look.total
        last = 2.0 * spread / gap
        closed = lambda look, wanted: abs(1 - look.total) < (1e-7 if wanted == gap else 1e-2) and primal(look) - look.value <= wanted

        def climb(dual, at: np.ndarray, theta: float, eta: float, end: float) -> tuple[np.ndarray, float, Look]:
            factor, look = 6.0, None
            while True:
                wanted = gap if eta == last else 1.5 * spread / eta
                done = lambda v, look, wanted=wanted: closed(look, wanted)
                to, drift, after = dual(eta).ascend(at, theta, done, rounds=100 if look is None else 10)
                if look is None or done(to, after) or factor < 1.2:
                    at, theta, look, reached = to, drift, after, eta
                    factor = min(6.0, factor * 1.5)
                    if eta == end:
                        return at, theta, look
                else:  # too far from the last solution
                    factor = factor**0.5
                eta = min(end, reached * factor)

        over_rows = lambda eta: self._dual(eta, nu, base=self.noise, logistic=True)
        first, look = min(last, 4.0), None
        cells = CellDual.of(over_rows(last).rows)
        if cells is not None:
            table, fine = cells
            near = min(last, 8.0 * fine)  # as sharp as cells allow
            start, theta, _ = climb(lambda eta: CellDual(table, eta, nu, self.m), v, 0.0, first, near)
            to, theta, look = climb(over_rows, start, theta, near, last)
        # over very many rows sums are too rough for the last digits of the total, from wherever one starts
        if look is None or abs(1 - look.total) > 1e-5 or primal(look) - look.value > gap:
            to, theta, look = climb(over_rows, v, 0.0, first, last)
        self._set(to, theta, last, nu, self.noise, look, True)
        return float(primal(look)), to

    def least_divergence(self, nu: float, bound: float) -> bool:
        most = math.log(self.m / nu)  # no distribution diverges more
        impossible = lambda look: look.value > most + 1e-9
        done = lambda v, look: impossible(look) or self._even(look) and look.edges.max() / look.total <= bound + self.gap and abs(look.primal_divergence() - look.value) <= 10 * self.gap
        dual = self._dual(1.0, nu, slope=-bound, domain="nonnegative")
        v, theta, look = dual.ascend(np.zeros(len(self.hypotheses)), 1.0, done, rounds=200)
        if impossible(look) or look.edges.max() / look.total > bound + 100 * self.gap:
            return False
        self._set(v, theta, 1.0, nu, None, look)
        return True

    def entropy(self, nu: float, eta: float, w: np.ndarray | None) -> tuple[float, np.ndarray]:
        t = len(self.hypotheses)
        start = np.full(t, 1.0 / t) if w is None else np.r_[w, np.zeros(t - len(w))]
        done = lambda v, look: self._even(look) and look.edges.max() / look.total + look.primal_divergence() / eta - look.value <= self.gap
        v, theta, look = self._path(eta, nu, start, done)
        self._set(v, theta, eta, nu, None, look)
        return float(look.value), v

    def _margin(self, w: np.ndarray) -> Column:
        return _sum([F.lit(0.0), *[F.lit(float(x)) * c for x, c in zip(w, self._columns(), strict=True) if x]])

    def smooth(self, w: np.ndarray, nu: float, eta: float) -> float:
        """Margins are columns of the dual that don't move, so that their edges are known, too."""
        theta = before = None
        even = lambda v, look: abs(1.0 - look.total) < 1e-10
        for e in self._stages(eta):
            dual = self._dual(e, nu, columns=[], base=self._margin(w))
            _, theta, look = dual.ascend(np.zeros(0), self._start(e, nu, theta, before), even if e == eta else lambda v, look: abs(1 - look.total) < 0.05)
            before = e
        full = self._dual(eta, nu).look(np.asarray(w, float), theta, [])
        self._set(np.asarray(w, float), theta, eta, nu, None, full)
        return float(look.value)

    def weight(self) -> Column:
        if self._point is None:
            return F.lit(1.0 / self.m)
        v, theta, eta, nu, base, logistic = self._point
        self.train.df = self.train.df.drop("__u").withColumn("__u", F.lit(theta) - (self._margin(v) if base is None else base + self._margin(v)))
        return F.expr(Dual.share("__u", eta, nu, self.m, logistic))

    def widest(self, direction: np.ndarray) -> float:
        return float(self.train.df.agg(F.max(F.abs(self._margin(direction)))).first()[0] or 0.0)

    def search(self, w: np.ndarray, direction: np.ndarray, most: float, nu: float, eta: float) -> float:
        """Newton's method in the step and theta together; each aggregate tries six steps."""
        self.smooth(w, nu, eta)
        theta = self._point[1]
        dual = self._dual(eta, nu, columns=[self._margin(direction)], base=self._margin(w), domain=float(most))

        def done(v: np.ndarray, look: Look) -> bool:
            e = look.edges[0] / look.total
            return self._even(look) and (abs(e) * most <= self.gap or v[0] <= 0 and e <= 0 or v[0] >= most and e >= 0)

        v, _, _ = dual.ascend(np.zeros(1), theta, done)
        return float(v[0])


class Switch(Programs):
    """Groups while they are few, rows from then on."""

    def __init__(self, train: Prepared, rows: bool = False, most: int = 100_000):
        self.train = train
        self.inner: Programs = RowPrograms(train) if rows else GroupPrograms(train, most)
        self.hypotheses: list[Classifier] = []

    @property
    def edges(self) -> np.ndarray:
        return self.inner.edges

    @property
    def divergence(self) -> float:
        return self.inner.divergence

    @property
    def over_rows(self) -> bool:
        return isinstance(self.inner, RowPrograms)

    def add(self, h: Classifier) -> None:
        try:
            self.inner.add(h)
        except TooManyGroups:
            self.inner.groups.release()
            self.inner = RowPrograms(self.train, [*self.hypotheses, h])
        self.hypotheses.append(h)

    def soft_margin(self, nu: float, gap: float) -> tuple[float, np.ndarray]:
        return self.inner.soft_margin(nu, gap)

    def least_divergence(self, nu: float, bound: float) -> bool:
        return self.inner.least_divergence(nu, bound)

    def entropy(self, nu: float, eta: float, w: np.ndarray | None) -> tuple[float, np.ndarray]:
        return self.inner.entropy(nu, eta, w)

    def smooth(self, w: np.ndarray, nu: float, eta: float) -> float:
        return self.inner.smooth(w, nu, eta)

    def weight(self) -> Column:
        return self.inner.weight()

    def widest(self, direction: np.ndarray) -> float:
        return self.inner.widest(direction)

    def search(self, w: np.ndarray, direction: np.ndarray, most: float, nu: float, eta: float) -> float:
        return self.inner.search(w, direction, most, nu, eta)
