"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint is the majority of each bit over the XXH64 values of its word shingles. Different
fingerprints only are compared, so a group of exact copies costs one row. They are put into blocks by
population count; two blocks whose population counts differ by more than the radius hold no pair within it
and never meet. Every other pair of blocks is a task of fixed size, in which tiles are compared with
exclusive-or and bit counts, again skipping tile pairs by the population counts of the two halves. A task
returns a spanning forest of its links, not the links, so a group of thousands of near copies gives
thousands of rows; the forests are joined by connected components.

Exact comparison of N different fingerprints is N * N / 2 bit counts but for the skipped tiles; blocks keep
their size, so a larger table has more tasks, not longer ones. Fingerprints that hold more than one in
``HOT`` rows (at most ``HOT`` of them) get their component by a broadcast, all others by a join.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; very long texts are whole, each a block of its own; every input
row gives one row, ties and repeats too; a null id has its row and is passed over when the smallest id of a
component is taken (null if there is no other); an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import LOWER, lanes, ragged, row_blocks, row_of, spans, text_column, trimmed, xxh64
from tessera.llm.components import HOT, components, forest
from tessera.session import materialize, ship

BITS = 64
TILE = 512
SHIFT = np.arange(BITS, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE


def fingerprints_of(buf: np.ndarray, offsets: np.ndarray, size: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of every row of a block of texts."""
    n = len(offsets) - 1
    folded = LOWER[buf]
    space = SPACE[folded]
    keep = ~space
    keep[1:] |= ~space[:-1]  # of a run of white space the first byte stays, as a space
    keep[offsets[:-1][offsets[:-1] < len(buf)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    joined = np.where(space, np.uint8(32), folded)[keep]
    starts, ends, counts = spans(joined, at, NOT_SPACE)
    shingles = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    before = np.cumsum(counts) - counts
    first = ragged(before, shingles)
    row = row_of(shingles)
    last = np.minimum(first + size, (before + counts)[row]) - 1
    a, length, view = starts[first], ends[last] - starts[first], lanes(joined)
    votes = np.zeros((n, BITS), np.int64)
    for i in range(0, len(a), 1 << 16):
        part = slice(i, i + (1 << 16))
        bits = np.unpackbits(xxh64(view, a[part], length[part], seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.diff(row[part], prepend=-1))
        votes[row[part][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return ((votes * 2 > shingles[:, None]) * (np.uint64(1) << SHIFT)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_column(batch.column(1))
            for i, j in row_blocks(at):
                fp = fingerprints_of(buf[at[i] : at[j]], at[i : j + 1] - at[i], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(scan), f"doc_id {kind}, fp long")


def _half(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int16)


def tile_links(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs of x and y within the radius; both are sorted by the bits of their lower half."""
    lx, ly = _half(x), _half(y)
    hx, hy = np.bitwise_count(x).astype(np.int16) - lx, np.bitwise_count(y).astype(np.int16) - ly
    gap = lambda a, b: max(0, int(b.min()) - int(a.max()), int(a.min()) - int(b.max()))
    for i in range(0, len(x), TILE):
        a = slice(i, i + TILE)
        for j in range(i if same else 0, len(y), TILE):
            b = slice(j, j + TILE)
            if gap(lx[a], ly[b]) + gap(hx[a], hy[b]) > radius:
                continue
            near = np.bitwise_count(x[a, None] ^ y[None, b]) <= radius
            if near.any():
                u, v = np.nonzero(near)
                yield u + i, v + j


def compare(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within x, or between x and y: node and the root it hangs from."""
    x = x[np.argsort(_half(x), kind="stable")]
    y = None if y is None else y[np.argsort(_half(y), kind="stable")]
    both = x if y is None else np.concatenate([x, y])
    label, shift = np.arange(len(both)), 0 if y is None else len(x)
    for u, v in tile_links(x, x if y is None else y, radius, y is None):
        label = forest(len(both), u, v + shift, label)
    at = np.flatnonzero(label != np.arange(len(both)))
    return both[at], both[label[at]]


def near_links(prints: DataFrame, radius: int = 4, block_rows: int = 32_768) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` (distinct longs) within the radius of each other."""
    spark = prints.sparkSession
    ship(spark)
    counted = {r["p"]: r["n"] for r in prints.groupBy(F.bit_count("fp").alias("p")).agg(F.count("*").alias("n")).collect()}
    blocks = [-(-counted.get(p, 0) // block_rows) for p in range(BITS + 1)]
    base = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    low = [base[max(0, p - radius)] for p in range(BITS + 1)]
    high = [base[min(BITS, p + radius) + 1] for p in range(BITS + 1)]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.bit_count("fp") + 1)
    own = prints.select("fp", (pick(base[:-1]) + F.pmod(F.xxhash64("fp"), pick([max(1, b) for b in blocks]))).cast("int").alias("own"), pick(low).alias("low"), pick(high).alias("high"))
    met = own.select("fp", "own", F.explode(F.sequence("low", F.col("high") - 1)).alias("other")).select("fp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    n_pairs = sum(h - lo for p, (lo, h) in enumerate(zip(low, high)) for _ in range(blocks[p]))
    parts = max(1, min(n_pairs, 4 * spark.sparkContext.defaultParallelism + 24))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        x, y = key[0].as_py(), key[1].as_py()
        mine = table.column("own").to_numpy() == x
        a, b = compare(fp[mine], None if x == y else fp[~mine], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return met.repartition(parts, "x", "y").groupBy("x", "y").applyInArrow(work, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    ship(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col, text_col, size), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(near_links(classes.select("fp"), radius))
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "first", "n", "root")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "n", "component_id").unionByName(classes.join(roots, classes.fp == roots.node, "left_anti").filter("n > 1").select("fp", "n", F.col("first").alias("component_id")))
    named = materialize(named, "named")  # fingerprints of one row without a link need none
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = named.filter(F.col("n") * HOT > total).select("fp", F.lit(True).alias("hot"), F.col("component_id").alias("hot_id"))
    cold = named.filter(F.col("n") * HOT <= total).select("fp", F.lit(True).alias("cold"), "component_id")
    print_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    marked = prints.join(F.broadcast(hot), "fp", "left")
    found = marked.filter("hot is null").join(cold, "fp", "left").select("doc_id", print_, F.when(F.col("cold"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return marked.filter("hot").select("doc_id", print_, F.col("hot_id").alias("component_id")).unionByName(found)
