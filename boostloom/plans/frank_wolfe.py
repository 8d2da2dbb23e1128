"""Frank-Wolfe steps over the weights of hypotheses."""

from __future__ import annotations

import numpy as np

from boostloom.plans.programs import Programs

#: The kinds of steps.
KINDS = ("classic", "short_step", "line_search", "blended_pairwise")


class FrankWolfe:
    """Moves weights towards one hypothesis.

    The smoothed soft margin's gradient are the edges under its distribution; `programs` knows these, the widest
    change of a margin along a direction, and the best step along it.
    """

    def __init__(self, eta: float, kind: str = "classic"):
        if kind not in KINDS:
            raise ValueError(f"{kind} isn't one of {', '.join(KINDS)}")
        self.eta, self.kind = eta, kind

    def next(self, w: np.ndarray, new: int, t: int, programs: Programs, nu: float) -> np.ndarray:
        """Weights after round t (from 1), in which the hypothesis `new` had the largest edge."""
        target = np.zeros(len(w))
        target[new] = 1.0
        if not w.sum():
            return target
        if self.kind == "classic":
            return interior_point(w, target, 2.0 / (t + 1))
        if self.kind == "line_search":
            return interior_point(w, target, programs.search(w, target - w, 1.0, nu, self.eta))
        programs.smooth(w, nu, self.eta)
        edges = programs.edges
        if self.kind == "short_step":
            widest = programs.widest(target - w)
            step = float(np.clip(edges @ (target - w) / (self.eta * widest**2), 0.0, 1.0)) if widest else 0.0
            return interior_point(w, target, step)
        return self._pairwise(w, new, edges, programs, nu)

    def _pairwise(self, w: np.ndarray, new: int, edges: np.ndarray, programs: Programs, nu: float) -> np.ndarray:
        """Moves weight from the worst hypothesis in use to the best one in use, if that promises more than the new one."""
        used = np.flatnonzero(w > 0)
        best, worst = used[edges[used].argmax()], used[edges[used].argmin()]
        if edges[best] - edges[worst] >= edges[new] - w @ edges and best != worst:
            direction, most = np.zeros(len(w)), w[worst]
            direction[best], direction[worst] = 1.0, -1.0
        else:
            direction, most = -w.copy(), 1.0
            direction[new] += 1.0
        out = np.maximum(w + programs.search(w, direction, most, nu, self.eta) * direction, 0.0)
        return out / out.sum()


def interior_point(w: np.ndarray, target: np.ndarray, step: float) -> np.ndarray:
    """The point a share `step` of the way from w to the target."""
    if not 0 <= step <= 1:
        raise ValueError("a step must lie between 0 and 1")
    return (1 - step) * w + step * target
