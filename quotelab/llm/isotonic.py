"""Isotonic calibration on a fixed grid: Spark sums each cell, the driver pools at most ``GRID`` cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 2048


class Isotonic:
    """Non-decreasing map from a raw value in [low, high] to a share between 0 and 1."""

    def __init__(self, at: np.ndarray, share: np.ndarray, low: float, high: float) -> None:
        self.at, self.share, self.low, self.high = at, share, low, high

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(raw), 0.5)
        return np.clip(np.interp(np.clip(raw, self.low, self.high), self.at, self.share), 0.0, 1.0)


def fit(rows: DataFrame, raw: str, target: str, low: float, high: float) -> Isotonic:
    """Pool adjacent violators over grid cells of ``raw``; with no rows the map is 0.5 everywhere."""
    cell = F.floor((F.least(F.greatest(F.col(raw), F.lit(low)), F.lit(high)) - low) / (high - low) * (GRID - 1))
    sums = rows.groupBy(cell.alias("cell")).agg(F.sum(F.col(target).cast("double")).alias("y"), F.count("*").alias("n"))
    blocks: list[list[float]] = []  # weighted cell, sum of targets, rows
    for cell_, y, n in sorted(sums.where("cell IS NOT NULL").collect()):
        blocks.append([cell_ * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([low + (b[0] / b[2] + 0.5) * (high - low) / (GRID - 1) for b in blocks])
    return Isotonic(at, np.array([b[1] / b[2] for b in blocks]), low, high)
