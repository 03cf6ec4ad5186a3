"""Vector columns for the operators that compare vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """The vector is there, not empty, and all of its components are finite numbers."""
    bad = F.exists(
        vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def farthest_first(points: np.ndarray, most: int, until: float = 0.0) -> np.ndarray:
    """Indices of a net: each next point is the one farthest from those before.

    Ends after ``most`` points or when all points lie within ``until`` of the net.
    """
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(points)):
        far = int(np.argmax(nearest))
        if nearest[far] <= until * until:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, ((points - points[far]) ** 2).sum(axis=1))
    return np.array(chosen)
