"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their numbers of tokens, at most ``table_size``
entries, which is broadcast. Tier two encodes what isn't in it, through a cache that each Python worker
keeps. Both compare a pre-token's bytes after finding it by hash. Pre-tokens are cut only where the
vocabulary lets no token cross, so their counts add up to the library's count of the whole text; of a
tokenizer whose cuts aren't known, whole texts are encoded. No text is shuffled.

The table is made from all documents (or ``table_docs`` of them, if given), by an aggregate over the ``table_size``
most frequent pre-tokens of each partition, with their numbers; it decides how fast a count is, never what it is.

Defined cases: a null text counts as empty and has no tokens; very long texts are whole, each a block of its
own; ids may be null or repeat (ties), each row is counted; an empty table gives none; of other columns,
whatever their names, none is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import SpanTable, lanes, row_blocks, span_hashes, text_column, trimmed
from tessera.llm._chunkcache import ChunkCache, adapter, worker_cache
from tessera.session import materialize, ship

_tier_one: dict[str, tuple[SpanTable, np.ndarray]] = {}


class Tally(SpanTable):
    """How often pre-tokens occur; when too many are held, the most frequent so far are set aside."""

    def __init__(self, keep: int, bits: int = 20) -> None:
        self.keep, self.done = keep, []
        super().__init__(bits)
        self.count = np.zeros(0, np.int64)

    def top(self) -> tuple[list[bytes], np.ndarray]:
        best = np.argsort(-self.count, kind="stable")[: self.keep]
        raw = self.raw.tobytes()
        return [raw[a : a + n] for a, n in zip(self.start[best].tolist(), self.size[best].tolist())], self.count[best]

    def see(self, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> None:
        short = np.flatnonzero(lengths <= 256)  # longer ones are never frequent enough to be worth their bytes
        _, first, n = np.unique(np.maximum(h[short], np.uint64(1)), return_index=True, return_counts=True)
        some = short[first]
        entry = self.find(view, starts[some], lengths[some], h[some])
        new = np.flatnonzero(entry < 0)
        if self.n + len(new) > self.table.limit and self.n:
            self.done.append(self.top())
            self.clear()
            self.count = np.zeros(0, np.int64)
            entry[:] = -1
            new = np.arange(len(some))
        fresh = new[self.table.get(h[some[new]]) < 0]
        fresh = fresh[: max(0, self.table.limit - self.n)]
        raw = view.base.tobytes()
        entry[fresh] = self.add(h[some[fresh]], [raw[a : a + k] for a, k in zip(starts[some[fresh]].tolist(), lengths[some[fresh]].tolist())])
        self.count = np.concatenate([self.count, np.zeros(self.n - len(self.count), np.int64)])
        known = entry >= 0
        np.add.at(self.count, entry[known], n[known])


def frequent(docs: DataFrame, text_col: str, model_path: str, table_size: int, table_docs: int | None = None) -> list[bytes]:
    """The most frequent pre-tokens, merged from those of each partition."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = worker_cache(model_path), Tally(table_size)
        for batch in batches:
            buf, offsets = text_column(batch.column(0))
            for i, j in row_blocks(offsets):
                view, starts, lengths, h, _ = cutter.cut(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seen.see(view, starts, lengths, h)
        for parts, n in [*seen.done, seen.top()]:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array(n)], names=["token", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    texts = texts if table_docs is None else texts.limit(table_docs)
    counted = materialize(texts.mapInArrow(trimmed(tally), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "tally")
    # the counts above which at most table_size pre-tokens lie; only those come to the driver
    step = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["step"]):
        held += r["m"]
        if held > table_size:
            break
        least = r["step"]
    return [] if least is None else [bytes(r["token"]) for r in counted.filter(step >= least).select("token").collect()]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, table_size: int = 65_536, table_docs: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    ship(docs.sparkSession)
    parts = frequent(docs, text_col, model_path, table_size, table_docs)
    cache = ChunkCache(adapter(model_path)(model_path))
    known = cache.learn(None, parts)
    sizes = cache.length[known]
    shared = docs.sparkSession.sparkContext.broadcast((parts, sizes))
    name = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(model_path)
        if name not in _tier_one:
            _tier_one.clear()
            _tier_one[name] = tier_one(*shared.value)
        table, sizes = _tier_one[name]
        for batch in batches:
            buf, offsets = text_column(batch.column(1))
            totals = [np.zeros(0, np.int64)]
            for i, j in row_blocks(offsets):
                totals.append(two_tiers(cache, table, sizes, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            n = np.concatenate(totals)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def tier_one(parts: list[bytes], sizes: np.ndarray) -> tuple[SpanTable, np.ndarray]:
    """The table of frequent pre-tokens; of several with one hash the first is held, the others are encoded."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    h = np.maximum(span_hashes(lanes(np.frombuffer(b"".join(parts), np.uint8)), np.cumsum(lengths) - lengths, lengths), np.uint64(1))
    _, first = np.unique(h, return_index=True)
    table = SpanTable(max(10, len(first).bit_length() + 1))
    table.add(h[first], [parts[i] for i in first.tolist()])
    return table, np.asarray(sizes)[first].astype(np.int64)


def two_tiers(cache: ChunkCache, table: SpanTable, sizes: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens by row: by the table where it knows the pre-token, else by the worker's cache."""
    view, starts, lengths, h, per_row = cache.cut(buf, offsets)
    entry = table.find(view, starts, lengths, h)
    size = np.zeros(len(starts), np.int64)
    known, missed = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
    size[known] = sizes[entry[known]]
    if len(missed):
        entry = cache.entries(view, starts[missed], lengths[missed], h[missed])
        size[missed] = cache.length[entry]
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.cumsum(per_row)
    return total[at] - total[at - per_row]
