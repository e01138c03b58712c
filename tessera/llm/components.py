"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a few joins and aggregations over the links that are left and is written to the shared
folder, so neither lineage nor driver grows with the table. The rounds end when no link changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

HOT = 4096


def _sign(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    # nodes with more than one in HOT of the links are at most HOT many: they are broadcast, others joined
    hot, cold = low.filter(F.col("n") * HOT > n).select("a", F.col("m").alias("hot")), low.filter(F.col("n") * HOT <= n).select("a", "m")
    marked = both.join(F.broadcast(hot), "a", "left")
    near = marked.filter("hot is not null").select("a", "b", F.col("hot").alias("m")).unionByName(marked.filter("hot is null").join(cold, "a").select("a", "b", "m"))
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long): node and root, the smallest node that it reaches, for all linked nodes."""
    now = materialize(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _sign(now)
    while before[0]:
        big = materialize(_star(now, True, 2 * before[0]), "links", now)
        now = materialize(_star(big, False, before[0]), "links", big)
        after = _sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(size: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of ``size`` nodes reaches by the pairs (u, v), carrying on from ``label``."""
    label = np.arange(size) if label is None else label
    if not len(u):
        return label
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == low).all() and (label[v] == low).all():
            return label
        for at in (u, v, label[u], label[v]):
            np.minimum.at(label, at, low)
        while not (label == (to := label[label])).all():
            label[:] = to
