"""A union-find over NumPy arrays, for the links found inside one bounded task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Components of nodes 0..n-1; links come in blocks, and only a spanning forest is kept."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            ru, rv = self.parent[u], self.parent[v]
            open_ = ru != rv
            u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
            if not len(u):
                return
            np.minimum.at(self.parent, np.maximum(ru, rv), np.minimum(ru, rv))
            self._flatten()

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that is not a root, and its root: as many links as the forest has edges."""
        self._flatten()
        at = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return at, self.parent[at]
