"""Folds and calibration that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(ident: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id is in fold 0."""
    return F.coalesce(F.crc32(ident.cast("string")) % of, F.lit(0))


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of bins by pooling neighbours; an empty bin takes the rate before it."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n > 0).tolist():
        blocks.append([float(positive[i]), float(n[i]), i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, m, i = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + m, i]
    out, at = np.full(len(n), 0.5), 0
    for p, m, i in blocks:
        out[at : i + 1] = p / m
        at = i + 1
    if blocks:
        out[at:] = blocks[-1][0] / blocks[-1][1]
    return out
