"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

A document becomes about forty statistics of its bytes, words and lines. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; the normal equations of a ridge regression on them
are summed by partition, so the driver gets a fixed number of matrices of fixed size. The fitted value is
turned into a probability by isotonic regression over a fixed number of bins, on a fold the ridge didn't see.

All labelled rows outside the held-out fold take part, in folds 2.. for the ridge and fold 1 for the
calibration. Labels, language, source and id are never inputs of a score. Sums are made by partition and
added up in two levels, so that the driver gets about the square root of the number of partitions of them.

Defined cases: a null or empty text has statistics of zero and is scored like any other; very long texts are
whole, each a block of its own; without labelled rows every score is 0.5; a document with several labels
counts with the largest; a null id is in the held-out fold; every row is scored, ties and repeats alike; an
empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import row_blocks, row_of, text_column, trimmed, words
from tessera.llm._fit import fold, isotonic
from tessera.session import materialize, ship

MARKS = b"|!*#%&$@.,-+()=\"':;?<>/"
N_STATS = 20 + len(MARKS)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
BINS = 512


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by row, and how often the most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[at], runs)
    return np.bincount(r[at], minlength=n), top


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATS statistics for every text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    hist = np.zeros((n, 256))
    for i, j in row_blocks(offsets):
        part, rows = buf[offsets[i] : offsets[j]], np.repeat(np.arange(j - i), size[i:j])
        for a in range(0, len(part), 1 << 20):
            hist[i:j] += np.bincount(rows[a : a + (1 << 20)] * 256 + part[a : a + (1 << 20)], minlength=(j - i) * 256).reshape(j - i, 256)
    share = hist / np.maximum(size, 1)[:, None]
    p = np.where(share > 0, share, 1)
    s, e, counts, h = words(buf, offsets, NOT_SPACE, fold=False)
    row, length = row_of(counts), (e - s).astype(float)
    per = lambda x: np.bincount(row, weights=x, minlength=n)
    mean = _ratio(per(length), counts)
    spread = np.sqrt(np.maximum(0, _ratio(per(length * length), counts) - mean**2))
    distinct, top = _distinct(row, h, n)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])[: len(h)]
    pair = (h[1:] * np.uint64(3) + h[:-1])[row[1:] == row[:-1]] if len(h) > 1 else h[:0]
    pair_row = row[1:][row[1:] == row[:-1]] if len(h) > 1 else row[:0]
    pairs, top_pair = _distinct(pair_row, pair, n)
    upper = (buf[s] >= 65) & (buf[s] <= 90) if len(s) else np.zeros(0, bool)
    last_mark = np.isin(buf[e - 1], np.frombuffer(b".!?", np.uint8)) if len(e) else np.zeros(0, bool)
    ls, le, lines, lh = words(buf, offsets, NOT_NEWLINE, fold=False)
    line_row = row_of(lines)
    distinct_lines, _ = _distinct(line_row, lh, n)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(counts), mean, spread, _ratio(distinct, counts), _ratio(top, counts), _ratio(per(same), counts), _ratio(pairs, counts), _ratio(top_pair, counts),
            share[:, 65:91].sum(axis=1), share[:, 97:123].sum(axis=1), share[:, 48:58].sum(axis=1), share[:, 128:].sum(axis=1), share[:, 10], -(p * np.log(p)).sum(axis=1),
            _ratio(per(upper), counts), _ratio(per(last_mark), counts), np.log1p(lines), np.log1p(_ratio(size, lines)), _ratio(distinct_lines, lines),
            np.sqrt(share[:, list(MARKS)]),
        ]
    )


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and x (its statistics) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_column(batch.column(1))
            for i, j in row_blocks(offsets):
                x = statistics(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "x"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(scan), f"doc_id {kind}, x array<float>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), N_STATS).astype(np.float64)


class Kernel:
    """Standardised statistics to random Fourier features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.maximum(spread, 1e-3)
        self.w = rng.normal(0, 1 / width, (N_STATS, features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all partitions of the vector that ``add`` makes of (y, x)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                total += add(batch.column(0).to_numpy().astype(float), _rows(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([part % groups]), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def together(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py()) for x in table.column("s")), np.zeros(size))
        return pa.table({"s": pa.array([total.tobytes()], pa.binary())})

    parts = rows.rdd.getNumPartitions()
    groups = max(1, math.isqrt(parts))
    sums = rows.select("y", "x").mapInArrow(trimmed(work), "g long, s binary")
    sums = sums.select("s") if parts < 64 else sums.groupBy("g").applyInArrow(together, "s binary")
    return sum((np.frombuffer(r["s"]) for r in sums.collect()), np.zeros(size))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, features: int = 256, width: float = 6.0, ridge: float = 1e-3, seed: int = 11) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship(docs.sparkSession)
    table = materialize(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y is not null and doc_id is not null").filter(fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", fold(F.col("doc_id"), 5))
    train = materialize(table.join(known, "doc_id").select("y", "x", "fold"), "train")
    ridge_rows, bin_rows = train.filter("fold <> 1"), train.filter("fold = 1")
    one = _summed(ridge_rows, 1 + 2 * N_STATS, lambda y, x: np.concatenate([[len(y)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n = max(1.0, one[0])
    mean = one[1 : 1 + N_STATS] / n
    kernel = Kernel(mean, np.sqrt(np.maximum(0, one[1 + N_STATS :] / n - mean**2)), features, width, seed)
    d = features + 1

    def equations(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = kernel(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    two = _summed(ridge_rows, d * d + d, equations)
    weights = np.linalg.solve(two[: d * d].reshape(d, d) + (ridge * n + 1e-6) * np.eye(d), two[d * d :])
    place = lambda x: np.clip((kernel(x) @ weights + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
    three = _summed(bin_rows, 2 * BINS, lambda y, x: np.concatenate([np.bincount(place(x), minlength=BINS), np.bincount(place(x), weights=y, minlength=BINS)]))
    rates = isotonic(three[:BINS], three[BINS:])
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates[place(_rows(batch.column(1)))] if batch.num_rows else np.zeros(0))], names=["doc_id", "score"])

    scored = table.mapInArrow(trimmed(score), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
