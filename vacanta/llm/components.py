"""Linking inside one task, next to the connected components of the library."""

from __future__ import annotations

import numpy as np

from ..operators.components import components as components


class Forest:
    """Groups of the points of one task; gives out an edge only where two groups meet."""

    def __init__(self, size: int) -> None:
        self.labels = np.arange(size)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def link(self, point: int, others: np.ndarray) -> None:
        """Link ``point`` with the points ``others`` (itself may be among them)."""
        groups, first = np.unique(self.labels[others], return_index=True)
        own = self.labels[point]
        new = groups != own
        if new.any():
            self.left.append(np.full(new.sum(), point))
            self.right.append(others[first[new]])
            self.labels[np.isin(self.labels, groups[new])] = own

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(self.left or [none]), np.concatenate(self.right or [none])
