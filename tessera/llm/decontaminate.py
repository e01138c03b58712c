"""Benchmark decontamination by winnowing.

Every text becomes a sequence of words. Of each ``window - k + 1`` consecutive k-gram hashes the smallest is
kept (the last of equals), so any shared span of ``window`` words shares a kept k-gram: the fingerprints of
documents are joined with those of the items and every hit is extended along its diagonal by up to
``window - k`` words per side; spans of at least ``window`` equal words are hits, and as each window holds a
kept k-gram of its own, none is missed. An item of n < window words is matched whole, at a level with k = n.

Words are compared as words: an item's word has a number, found by hash and then compared byte for byte, and
a document's word that no item has matches nothing. Hashes of k-grams only find candidates.

A benchmark of at most ``block_words`` words is one index, which is broadcast: its size is checked, and the
join happens where the documents are read, so that they aren't shuffled. A larger one stays a table: Spark
joins the fingerprints of both sides (documents' ones after a fixed-size bit filter), items' fingerprints
with equal surroundings being one row, and hot ones being salted over ``SALTS`` rows. Nothing is skipped.

Defined cases: a null or empty text has no words; an item with a null id marks words but is no counted
item; repeated items with one id count once; each input row gives one output row, also when ids repeat or
are null (ties); very long texts are whole, each a block of its own; an empty benchmark hits nothing, an
empty table gives none; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm._bytes import GRAM, LOWER, SpanTable, lanes, mix, ragged, row_blocks, row_of, span_bytes, span_hashes, spans, text_column, trimmed, vocabulary
from tessera.session import materialize, ship

SCHEMA = "doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,last:long>>"
NOTHING = hashlib.sha256(b"").hexdigest()
FILTER_BITS = 24
SALTS = 16
_loaded: dict[str, dict] = {}


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out ^ (h[i : len(h) - k + 1 + i] * GRAM[i]))
    return out


def winnow(g: np.ndarray, row: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of kept k-grams; windows lie inside rows."""
    n = len(row) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for i in range(1, window - k + 1):
        better = g[i : i + n] <= best
        best[better] = g[i : i + n][better]
        at[better] = np.flatnonzero(better) + i
    keep = np.zeros(len(g), bool)
    keep[at[row[:n] == row[window - 1 :]]] = True
    return np.flatnonzero(keep)


def _context(word: np.ndarray, row: np.ndarray, at: np.ndarray, k: int, reach: int, outside: int) -> np.ndarray:
    """Words from ``reach`` before to ``reach`` after the k-grams at ``at``; beyond a row's ends ``outside``."""
    index = at[:, None] + np.arange(-reach, k + reach)
    inside = (index >= 0) & (index < len(word))
    index = np.clip(index, 0, max(0, len(word) - 1))
    return np.where(inside & (row[index] == row[at][:, None]), word[index], outside)


def build_level(word: np.ndarray, row: np.ndarray, k: int, window: int) -> dict:
    """Kept k-grams of item texts, one for each different surrounding, with the items that have it."""
    g = grams(word.astype(np.uint64), k)
    at = winnow(g, row, k, window)
    around = _context(word, row, at, k, window - k, -2)
    pairs = np.unique(np.column_stack([around, row[at]]), axis=0) if len(at) else np.zeros((0, window * 2 - k + 1), np.int64)
    new = np.concatenate([[True], (pairs[1:, :-1] != pairs[:-1, :-1]).any(axis=1)]) if len(pairs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    around = pairs[first, :-1]
    reach = window - k
    own = np.zeros(len(first), np.uint64)
    for i in range(k):
        own = mix(own ^ (around[:, reach + i].astype(np.uint64) * GRAM[i]))
    order = np.argsort(own, kind="stable")
    sizes = np.diff(np.append(first, len(pairs)))[order]
    seen = np.zeros(1 << 20, bool)
    seen[(own >> np.uint64(44)).astype(np.int64)] = True
    return {"k": k, "window": window, "grams": own[order], "around": around[order].astype(np.int32), "items": pairs[:, -1][ragged(first[order], sizes)], "ends": np.cumsum(sizes), "seen": seen}


def match(level: dict, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and ends of hit spans, and the surroundings of the index that they match."""
    k, window = level["k"], level["window"]
    reach = window - k
    g = grams(word.astype(np.uint64), k)
    at = winnow(g, row, k, window)
    at = at[level["seen"][(g[at] >> np.uint64(44)).astype(np.int64)]]
    lo, hi = np.searchsorted(level["grams"], g[at], "left"), np.searchsorted(level["grams"], g[at], "right")
    live = np.flatnonzero(hi > lo)
    at, lo, n = at[live], lo[live], (hi - lo)[live]
    out, step = [(np.zeros(0, np.int64),) * 3], 0
    while step < len(at):  # candidates in bounded lots
        total = np.cumsum(n[step:])
        end = step + max(1, int(np.searchsorted(total, 1 << 18, "right")))
        entry = ragged(lo[step:end], n[step:end])
        where = np.repeat(at[step:end], n[step:end])
        same = _context(word, row, where, k, reach, -3) == level["around"][entry]
        middle = same[:, reach : reach + k].all(axis=1)
        left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1) if reach else np.zeros(len(where), int)
        right = np.cumprod(same[:, reach + k :], axis=1).sum(axis=1) if reach else np.zeros(len(where), int)
        good = middle & (left + k + right >= window)
        out.append((where[good] - left[good], where[good] + k + right[good], entry[good]))
        step = end
    return tuple(np.concatenate(x) for x in zip(*out))


def _index(rows: list, window: int, k: int) -> bytes:
    buf, offsets = text_column(pa.array([r[1] for r in rows], pa.string()))
    starts, ends, counts = spans(LOWER[buf], offsets)
    view = lanes(LOWER[buf])
    raw = [span_bytes(view, a, b - a) for a, b in zip(starts.tolist(), ends.tolist())]
    known = {w: i for i, w in enumerate(dict.fromkeys(raw))}
    table, seed = vocabulary(list(known))
    word, row = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw)), row_of(counts)
    levels = []
    for n in sorted({min(int(c), window) for c in counts if c}):
        own = (counts >= window) if n == window else (counts == n)
        mask = own[row]
        levels.append(build_level(word[mask], row[mask], min(k, n) if n == window else n, n))
    return pickle.dumps({"ids": [r[0] for r in rows], "levels": levels, "words": list(known), "seed": seed}, protocol=5)


def _load(key: str, shared) -> dict:
    """The index, kept by the worker until another one is asked for."""
    if key not in _loaded:
        _loaded.clear()
        index = pickle.loads(shared.value)
        index["table"] = vocabulary(index["words"])[0]
        _loaded[key] = index
    return _loaded[key]


def _scan(index: dict, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Words by row, which words are hit, and the ids of the items by row."""
    folded = LOWER[buf]
    starts, ends, counts = spans(folded, offsets)
    view, row = lanes(folded), row_of(counts)
    word = index["table"].find(view, starts, ends - starts, span_hashes(view, starts, ends - starts, index["seed"])).astype(np.int64)
    delta = np.zeros(len(word) + 1, np.int64)
    items: dict[int, set] = {}
    for level in index["levels"]:
        first, end, entry = match(level, word, row)
        np.add.at(delta, first, 1)
        np.add.at(delta, end, -1)
        if len(first):
            for r, e in np.unique(np.column_stack([row[first], entry]), axis=0).tolist():
                items.setdefault(r, set()).update(index["ids"][i] for i in level["items"][(level["ends"][e - 1] if e else 0) : level["ends"][e]].tolist())
    return counts, np.cumsum(delta[:-1]) > 0, [items.get(r, set()) - {None} for r in range(len(counts))]


def _spans_of(hit: np.ndarray, row: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    """Runs of hit words by row, positions from the row's first word."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    before = np.cumsum(counts) - counts
    out: list[list[dict]] = [[] for _ in range(len(counts))]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        while a < b:
            r = int(row[a])
            start = int(before[r])
            stop = min(b, start + int(counts[r]))
            out[r].append({"first": a - start, "last": stop - 1 - start})
            a = stop
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, k: int = 5, min_items: int = 2, block_words: int = 2_000_000, whole: bool = False) -> DataFrame:
    """Per document row: words, words in shared windows, their spans, and the items they come from.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first and last word); with
    ``whole`` also the row itself as a struct ``document``.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t")).alias("n"), F.count("*").alias("m")).first()
    rows = docs.select(F.col(f"`{id_col}`"), F.struct("*").alias("document") if whole else F.col(f"`{text_col}`").cast("string"))
    inner = docs.columns.index(text_col) if whole else None
    if (size["n"] or 0) > 6 * block_words or size["m"] > block_words:
        return _joined(rows, inner, items, window, k, min_items)
    shared = spark.sparkContext.broadcast(_index([tuple(r) for r in items.collect()], window, k))
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _load(key, shared)
        for batch in batches:
            data, at = text_column(batch.column(1) if inner is None else pc.struct_field(batch.column(1), [inner]))
            for i, j in row_blocks(at):
                counts, hit, ids = _scan(index, data[at[i] : at[j]], at[i : j + 1] - at[i])
                row = row_of(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(counts, pa.int64()),
                        pa.array(np.bincount(row, weights=hit, minlength=j - i).astype(np.int64) if len(row) else np.zeros(j - i, np.int64)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else NOTHING for x in ids]),
                        pa.array([len(x) >= min_items for x in ids]),
                        pa.array(_spans_of(hit, row, counts), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        *(c.slice(i, j - i) for c in batch.columns[1 : 1 + whole]),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *(["document"] if whole else [])],
                )

    # a whole row has its text inside, so it is sent once
    schema = StructType.fromDDL(SCHEMA.format(kind=rows.schema[0].dataType.simpleString()))
    return rows.mapInArrow(trimmed(scan), StructType(schema.fields + rows.schema.fields[1 : 1 + whole]))


# a benchmark of any size: both sides' fingerprints as tables


def _prints(buf: np.ndarray, offsets: np.ndarray, levels: list[tuple[int, int]], longest: int, wanted: np.ndarray | None) -> tuple[np.ndarray, Iterator]:
    """Words by row, and per level the kept k-grams that pass the filter, with their surroundings as words.

    A row of more than n words is at a level (k, n) only if n is at least ``longest``.
    """
    folded = LOWER[buf]
    starts, ends, counts = spans(folded, offsets)
    view, row = lanes(folded), row_of(counts)
    h, before = span_hashes(view, starts, ends - starts), np.cumsum(counts) - counts

    def found() -> Iterator[tuple]:
        for k, n in levels:
            own = np.flatnonzero((counts >= n)[row] if n >= longest else (counts == n)[row])
            g = grams(h[own], k)
            at = winnow(g, row[own], k, n)
            if wanted is not None:
                at = at[wanted[(g[at] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
            reach = n - k
            for p in at.tolist():
                w = int(own[p])
                r = int(row[w])
                a, b = max(int(before[r]), w - reach), min(int(before[r] + counts[r]), w + k + reach)
                text = [span_bytes(view, int(starts[q]), int(ends[q] - starts[q])).decode() for q in range(a, b)]
                yield r, n, int(g[p : p + 1].view(np.int64)[0]), w - int(before[r]), text[: w - a][::-1], " ".join(text[w - a : w - a + k]), text[w - a + k :]

    return counts, found()


def _run(a: Column, b: Column, reach: int) -> Column:
    """How many words two lists begin with in common."""
    out = F.lit(0)
    for i in reversed(range(reach)):
        out = F.when(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), out + 1).otherwise(0)
    return out


def _joined(rows: DataFrame, inner: int | None, items: DataFrame, window: int, k: int, min_items: int) -> DataFrame:
    spark, whole = rows.sparkSession, inner is not None
    every = [(min(k, window), window)] + [(n, n) for n in range(1, window)]
    hit = "n int, g long, pos long, before array<string>, middle string, after array<string>"

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch.column(1))
            for i, j in row_blocks(at):
                _, found = _prints(data[at[i] : at[j]], at[i : j + 1] - at[i], every, window, None)
                ids = batch.column(0).slice(i, j - i).to_pylist()
                out = [(ids[r], *x) for r, *x in found]
                yield pa.RecordBatch.from_pylist([dict(zip(("item", "n", "g", "pos", "before", "middle", "after"), x)) for x in out], schema=kept)

    lists = pa.list_(pa.string())
    parts = [("n", pa.int32()), ("g", pa.int64()), ("pos", pa.int64()), ("before", lists), ("middle", pa.string()), ("after", lists)]
    kept = pa.schema([("item", pa.string()), *parts])
    place = ["n", "g", "before", "middle", "after"]
    index = materialize(
        items.mapInArrow(trimmed(of_items), f"item string, {hit}").groupBy(*place).agg(F.collect_set("item").alias("items")), "fingerprints")
    lengths = [r["n"] for r in index.select("n").distinct().collect()]
    top = F.shiftrightunsigned("g", 64 - FILTER_BITS)
    bits = index.groupBy(F.bitmap_bucket_number(top).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(top)).alias("bits")).collect()  # 2 MB at most
    wanted = np.zeros((1 << FILTER_BITS) + (1 << 16), bool)
    for r in bits:
        some = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        first = (r["b"] - 1) * 32768 + 1 if r["b"] > 0 else 0
        at = np.flatnonzero(some) + first
        wanted[at[at < 1 << FILTER_BITS]] = True
    wanted[0] = True  # position 0 has a bucket of its own
    shared = spark.sparkContext.broadcast(np.packbits(wanted[: 1 << FILTER_BITS]))
    levels = [x for x in every if x[1] in lengths]

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passing = TaskContext.get().partitionId() << 36, np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            data, at = text_column(batch.column(1) if inner is None else pc.struct_field(batch.column(1), [inner]))
            for i, j in row_blocks(at):
                counts, found = _prints(data[at[i] : at[j]], at[i : j + 1] - at[i], levels, 0, passing)
                hits: list[list[dict]] = [[] for _ in range(j - i)]
                for r, *x in found:
                    hits[r].append(dict(zip(("n", "g", "pos", "before", "middle", "after"), x)))
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + m)), batch.column(0).slice(i, m), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct(parts))), *(c.slice(i, m) for c in batch.columns[1 : 1 + whole])],
                    names=["row", "doc_id", "n_words", "hits", *(["document"] if whole else [])],
                )
                key += m

    schema = StructType.fromDDL(f"row long, doc_id {rows.schema[0].dataType.simpleString()}, n_words long, hits array<struct<{hit.replace(' ', ':').replace(',:', ',')}>>")
    read = materialize(rows.mapInArrow(trimmed(of_docs), StructType(schema.fields + rows.schema.fields[1 : 1 + whole])), "marked")
    mine = read.select("row", F.inline("hits")).withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int"))
    other = index.select("n", "g", "middle", F.col("before").alias("b2"), F.col("after").alias("a2"), F.xxhash64("before", "after").alias("context"), "items").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    reach = window - min(k, window)
    left, right = _run(F.col("before"), F.col("b2"), reach), _run(F.col("after"), F.col("a2"), reach)
    size = F.when(F.col("n") == window, F.lit(min(k, window))).otherwise(F.col("n"))
    both = mine.join(other, ["n", "g", "middle", "salt"]).select(
        "row", "items", (F.col("pos") - F.when(F.col("n") == window, left).otherwise(0)).alias("first"),
        (F.col("pos") + size - 1 + F.when(F.col("n") == window, right).otherwise(0)).alias("last"), "n")
    met = materialize(both.filter(F.col("last") - F.col("first") + 1 >= F.col("n")), "met")
    ids = met.select("row", F.explode("items").alias("i")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("ids"))
    # intervals in order become runs of hit words
    by = Window.partitionBy("row").orderBy("first", "last")
    reached = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = met.select("row", "first", "last").distinct().withColumn("new", F.when(F.coalesce(F.col("first") <= reached + 1, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    joined = runs.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    places = joined.groupBy("row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    n_items = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids"))
    out = read.drop("hits").join(ids, "row", "left").join(places, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>")).alias("spans"),
        *(["document"] if whole else []),
    )
