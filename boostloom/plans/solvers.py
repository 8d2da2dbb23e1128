"""Convex programs over groups of rows with equal margins: a linear program and entropy programs.

A group g stands for n_g rows; margins are a matrix of groups by hypotheses.
"""

from __future__ import annotations

import numpy as np

from boostloom.functions.projection import capped


def interior_point(a: np.ndarray, b: np.ndarray, c: np.ndarray, upper: np.ndarray, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of: least c x with a x = b, 0 <= x <= upper (inf: no bound), and of the equations' multipliers.

    Mehrotra's predictor and corrector; the normal equations have a row for each equation.
    """
    m, n = a.shape
    bounded = np.isfinite(upper)
    u = np.where(bounded, upper, 1.0)
    x = np.where(bounded, u / 2, 1.0)
    v = np.where(bounded, u - x, 1.0)
    y, s, w = np.zeros(m), np.ones(n), np.where(bounded, 1.0, 0.0)
    count = n + bounded.sum()
    best, kept = np.inf, (x, y)
    for _ in range(rounds):
        primal, dual = b - a @ x, c - a.T @ y - s + w
        room = np.where(bounded, u - x - v, 0.0)
        mu = (x @ s + (v * w)[bounded].sum()) / count
        error = max(np.abs(primal).max(), np.abs(dual).max(), np.abs(room).max(), mu)
        if not error < 1e3 * best:  # rounding has taken over
            return kept
        if error < best:
            best, kept = error, (x, y)
        if error < tol:
            break

        def solve(rxs: np.ndarray, rvw: np.ndarray) -> tuple[np.ndarray, ...]:
            t = 1.0 / (s / x + np.where(bounded, w / v, 0.0))
            r = dual - rxs / x + np.where(bounded, (rvw - w * room) / v, 0.0)
            normal = (a * t) @ a.T
            normal[np.diag_indices(m)] += 1e-14 * max(1.0, np.trace(normal) / m)
            dy = np.linalg.solve(normal, primal + a @ (t * r))
            dx = t * (a.T @ dy - r)
            dv = np.where(bounded, room - dx, 0.0)
            return dx, dy, (rxs - s * dx) / x, dv, np.where(bounded, (rvw - w * dv) / v, 0.0)

        def step(dx, ds, dv, dw) -> tuple[float, float]:
            most = lambda z, d: min([1.0, *(-z[d < 0] / d[d < 0])])
            return min(most(x, dx), most(v[bounded], dv[bounded])), min(most(s, ds), most(w[bounded], dw[bounded]))

        dx, _, ds, dv, dw = solve(-x * s, -v * w)
        ap, ad = step(dx, ds, dv, dw)
        ahead = ((x + ap * dx) @ (s + ad * ds) + ((v + ap * dv) * (w + ad * dw))[bounded].sum()) / count
        sigma = (ahead / mu) ** 3 * mu
        dx, dy, ds, dv, dw = solve(sigma - x * s - dx * ds, sigma - v * w - dv * dw)
        ap, ad = step(dx, ds, dv, dw)
        ap, ad = min(1.0, 0.9995 * ap), min(1.0, 0.9995 * ad)
        x, v, y, s, w = x + ap * dx, v + ap * dv, y + ad * dy, s + ad * ds, w + ad * dw
        v, w = np.where(bounded, v, 1.0), np.where(bounded, w, 0.0)
    return kept


def soft_margin_lp(margins: np.ndarray, number: np.ndarray, nu: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(value, w, d): the largest rho - (1/nu) sum of slacks over w in the simplex, and the dual.

    The dual is the least g with margins' d <= g, d in the simplex, a row's share at most 1/nu; d is
    returned for one row of each group.
    """
    g, t = margins.shape
    a = np.zeros((t + 1, g + t + 1))
    a[:t, :g], a[:t, g : g + t], a[:t, -1] = margins.T, np.eye(t), -1.0
    a[t, :g] = 1.0
    b = np.r_[np.full(t, -1.0), 1.0]  # the last variable is g + 1, which isn't negative
    c = np.zeros(g + t + 1)
    c[-1] = 1.0
    upper = np.r_[number / nu, np.full(t + 1, np.inf)]
    x, y = interior_point(a, b, c, upper)
    w = np.maximum(-y[:t], 0.0)
    w = w / w.sum() if w.sum() > 0 else np.full(t, 1.0 / t)
    d = np.maximum(x[:g], 0.0)
    d = d / d.sum() / number
    return float(x[-1] - 1.0), w, d


def sign_change(slope, most: float) -> float:
    """Where a falling slope changes its sign in [0, most], by bisection to 1e-9."""
    if slope(most) >= 0:
        return most
    low, high = 0.0, most
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) >= 0 else (low, mid)
    return low


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point of the probability simplex."""
    u = np.sort(v)[::-1]
    total = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    k = np.flatnonzero(u > total)[-1]
    return np.maximum(v - total[k], 0.0)


def divergence(d: np.ndarray, number: np.ndarray) -> float:
    """From the uniform distribution over the rows."""
    live = d > 0
    return float((number[live] * d[live] * np.log(d[live])).sum() + np.log(number.sum()))


def entropy_program(margins: np.ndarray, number: np.ndarray, nu: float, eta: float, w: np.ndarray | None = None, rounds: int = 3000, tol: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """(value, w, d) of: the least over d of max_j edge_j(d) + divergence(d) / eta, d in the capped simplex.

    By its dual over w, whose gradient is the edges under the capped exponential weights: accelerated
    projected ascent; the duality gap is max edge - w edges.
    """
    t = margins.shape[1]
    w = np.full(t, 1.0 / t) if w is None else np.r_[w, np.zeros(t - len(w))]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = capped(-eta * (margins @ w), number, 1.0 / nu)
        edges = margins.T @ (number * d)
        return float(w @ edges + divergence(d, number) / eta), edges, d

    value, edges, d = at(w)
    z, momentum, step = w, 1.0, 1.0
    z_value, z_edges = value, edges
    for _ in range(rounds):
        if edges.max() - w @ edges <= tol:
            break
        while True:
            new = simplex(z + step * z_edges)
            new_value, new_edges, new_d = at(new)
            move = new - z
            if new_value >= z_value + z_edges @ move - (move @ move) / (2 * step) - 1e-13 or step < 1e-12:
                break
            step /= 2
        if new_value < value - 1e-13:  # momentum overshot
            z, z_value, z_edges, momentum = w, value, edges, 1.0
            step /= 2
            if step < 1e-12:
                break
            continue
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        z = new + (momentum - 1) / after * (new - w)
        w, value, edges, d, momentum = new, new_value, new_edges, new_d, after
        z_value, z_edges, _ = at(z)
        step *= 1.3
    return value, w, d


def least_divergence(margins: np.ndarray, number: np.ndarray, nu: float, bound: float, rounds: int = 4000, tol: float = 1e-8) -> np.ndarray | None:
    """The d of least divergence in the capped simplex whose edges are all at most `bound`; None if there is none."""
    if soft_margin_lp(margins, number, nu)[0] > bound + 1e-9:
        return None
    weight = np.zeros(margins.shape[1])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = capped(-(margins @ w), number, 1.0 / nu)
        over = margins.T @ (number * d) - bound
        return float(w @ over + divergence(d, number)), over, d

    value, over, d = at(weight)
    z, momentum, step, z_value, z_over = weight, 1.0, 1.0, value, over
    for _ in range(rounds):
        if over.max() <= tol and abs(weight @ over) <= tol:
            break
        while True:
            new = np.maximum(z + step * z_over, 0.0)
            new_value, new_over, new_d = at(new)
            move = new - z
            if new_value >= z_value + z_over @ move - (move @ move) / (2 * step) - 1e-13 or step < 1e-12:
                break
            step /= 2
        if new_value < value - 1e-13:
            z, z_value, z_over, momentum = weight, value, over, 1.0
            step /= 2
            if step < 1e-12:
                break
            continue
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        z = np.maximum(new + (momentum - 1) / after * (new - weight), 0.0)
        weight, value, over, d, momentum = new, new_value, new_over, new_d, after
        z_value, z_over, _ = at(z)
        step *= 1.3
    return d
