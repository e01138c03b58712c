"""Embedding near-duplicates by the epsilon grid order join.

Unit vectors with a cosine of at least ``cosine`` are at most ``eps = sqrt(2 - 2 cosine)`` apart, also in
every projection. Vectors get grid cells of that size on their leading principal directions and are sorted
by label and cell (the epsilon grid order), then cut into blocks. Blocks whose cells are more than one apart
in a direction hold no link and don't meet. A pair of blocks that may is one bounded task, which joins the
two sequences recursively: intervals that are provably distant are skipped, others are halved until they
are small enough to compare exactly, in double precision.

Equal vectors of a label (found by 128 bits of hashes) are one class with a number of its own and are
compared once; classes with more than one in ``HOT`` rows are told their rows by a broadcast, others by a join. A task returns sums of links and a spanning
forest, so no group of copies is expanded into its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
nor do rows with a null label; vectors of different lengths don't link; each row gives one row; a null id is
passed over when the smallest id of a component is taken; kept is whether an id is its component's smallest;
ties and repeated rows link like others; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import trimmed
from tessera.llm.components import HOT, components, forest
from tessera.session import materialize, ship

LEAF = 128


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.diff(column.offsets.to_numpy())
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, _units(_matrix(column.take(pa.array(at))))


def principal(classes: DataFrame, directions: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and leading principal directions by vector length, from sums by partition over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                s = sums.setdefault(x.shape[1], [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + len(x), s[1] + x.sum(axis=0), s[2] + x.T @ x
        for n, (count, one, two) in sums.items():
            flat = np.concatenate([[count], one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), n)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["n", "i", "v"])

    found: dict[int, tuple] = {}
    sums = classes.select("vector").mapInArrow(trimmed(moments), "n long, i long, v double").groupBy("n", "i").agg(F.sum("v").alias("v")).toPandas()
    for n, part in sums.groupby("n"):
        flat = np.zeros(1 + n + n * n)
        flat[part["i"].to_numpy()] = part["v"].to_numpy()
        mean = flat[1 : n + 1] / flat[0]
        _, vectors = np.linalg.eigh(flat[n + 1 :].reshape(n, n) / flat[0] - np.outer(mean, mean))
        found[int(n)] = mean, vectors[:, ::-1][:, :directions].copy()
    return found


def ego_pairs(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of linked pairs of two sequences in grid order, by recursion on intervals."""
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        if a >= b or c >= d or same and d <= a:
            continue
        p, q = cx[a:b], cy[c:d]
        if ((p.min(axis=0) - q.max(axis=0) > 1) | (q.min(axis=0) - p.max(axis=0) > 1)).any():
            continue
        if b - a <= LEAF and d - c <= LEAF:
            u, v = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            u, v = u + a, v + c
            if same:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield u, v
        elif b - a >= d - c:
            m = (a + b) // 2
            work += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            work += [(a, b, c, m), (a, b, m, d)]


def vector_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, directions: int = 6, block_rows: int = 2_048) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = rows.sparkSession
    ship(spark)
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    kind = rows.schema[id_col].dataType.simpleString()
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.col(f"`{label_col}`").isNotNull() & raw.isNotNull() & F.coalesce(F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(raw, lambda v: v != 0), F.lit(False))
    base = materialize(
        rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(good, F.lit(False)).alias("good"), F.col(f"`{label_col}`").cast("string").alias("label"), raw.alias("vector"))
        .withColumns({"h1": F.when(F.col("good"), F.xxhash64("label", "vector")), "h2": F.when(F.col("good"), F.xxhash64(F.lit("second"), "label", "vector"))}), "vectors")
    classes = materialize(base.filter("good").groupBy("h1", "h2", "label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    axes = spark.sparkContext.broadcast(principal(classes, directions))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, directions), np.int64)
            at_vector = batch.schema.get_field_index("vector")
            for at, x in _by_length(batch.column(at_vector)):
                mean, vectors = axes.value[x.shape[1]]
                cells[at, : vectors.shape[1]] = np.floor((x - mean) @ vectors / eps)
            offsets = pa.array(np.arange(batch.num_rows + 1) * directions, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], names=[*batch.schema.names, "cell"])

    shape = ["label", "size"]
    gridded = classes.select("class", "label", "vector", "first", "n", F.size("vector").alias("size")).mapInArrow(trimmed(place), f"class long, label string, vector array<double>, first {kind}, n long, size int, cell array<long>")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = gridded.repartitionByRange(parts, *shape, "cell", "class").sortWithinPartitions(*shape, "cell", "class")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()))
            out = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                if key != last or held == block_rows:
                    number, held, last = number + 1, 0, key
                out[i], held = number, held + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    table = materialize(ordered.mapInArrow(trimmed(blocks), f"class long, label string, vector array<double>, first {kind}, n long, size int, cell array<long>, block long"), "grid")
    sides = [F.min(F.col("cell")[i]).alias(f"lo{i}") for i in range(directions)] + [F.max(F.col("cell")[i]).alias(f"hi{i}") for i in range(directions)]
    boxes = materialize(table.groupBy(*shape, "block").agg(*sides), "boxes")
    low, high = boxes.agg(F.min("lo0"), F.max("hi0")).first()
    width = max(1, ((high or 0) - (low or 0)) // 4096)  # a block meets others in at most about 4,096 steps, however small a cell is
    step = lambda c: F.floor(c / width).cast("long")
    left = boxes.select(*shape, F.col("block").alias("x"), *[F.col(f"{s}{i}").alias(f"x{s}{i}") for s in ("lo", "hi") for i in range(directions)], F.explode(F.sequence(step(F.col("lo0")), step(F.col("hi0")))).alias("c"))
    right = boxes.select(*shape, F.col("block").alias("y"), *[F.col(f"{s}{i}").alias(f"y{s}{i}") for s in ("lo", "hi") for i in range(directions)], F.explode(F.sequence(step(F.col("lo0") - 1), step(F.col("hi0") + 1))).alias("c"))
    met = left.join(right, [*shape, "c"]).filter("x <= y" + "".join(f" and xlo{i} - yhi{i} <= 1 and ylo{i} - xhi{i} <= 1" for i in range(directions))).select("x", "y").distinct()
    sent = met.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("block"))

    def work(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("block", "ascending")])
        x_is, y_is = key[0].as_py(), key[1].as_py()
        block = group.column("block").to_numpy()
        cells = np.array(group.column("cell").to_pylist(), np.int64).reshape(len(block), directions)
        column = group.column("vector").combine_chunks()
        unit = _units(_matrix(column))
        order = np.lexsort([*cells.T[::-1], block])
        unit, cells, block = unit[order], cells[order], block[order]
        n, node = group.column("n").to_numpy()[order], group.column("class").to_numpy()[order]
        m = int((block == x_is).sum()) if x_is != y_is else 0
        links, label = np.zeros(len(n), np.int64), np.arange(len(n))
        pairs = ego_pairs(unit, cells, unit, cells, cosine, True) if x_is == y_is else ((u, v + m) for u, v in ego_pairs(unit[:m], cells[:m], unit[m:], cells[m:], cosine, False))
        for u, v in pairs:
            np.add.at(links, u, n[v])
            np.add.at(links, v, n[u])
            label = forest(len(n), u, v, label)
        at = np.flatnonzero(links)
        return pa.table({"a": node[at], "b": node[label[at]], "links": links[at]})

    tasks = max(parts, 2 * spark.sparkContext.defaultParallelism)
    found = materialize(sent.join(table.select("block", "class", "vector", "n", "cell"), "block").repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(work, "a long, b long, links long"), "found")
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "class", "first", "n").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").select("h1", "h2", "first", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    final = materialize(named.join(smallest, "root").select("h1", "h2", "n", F.struct("n_links", "component").alias("found")), "final")
    total = final.agg(F.sum("n")).first()[0] or 0
    marked = base.select("id", "h1", "h2").join(F.broadcast(final.filter(F.col("n") * HOT > total).select("h1", "h2", F.col("found").alias("hot"))), ["h1", "h2"], "left")
    cold = marked.filter("hot is null").drop("hot").join(final.filter(F.col("n") * HOT <= total).select("h1", "h2", "found"), ["h1", "h2"], "left").select("id", "found")
    out = marked.filter("hot is not null").select("id", F.col("hot").alias("found")).unionByName(cold)
    component = F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("found.component"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("found.n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
