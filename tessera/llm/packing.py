"""Concatenate and cut: documents become one stream of token ids, cut into sequences of equal length.

Pass one tokenizes and writes, for every document, its ids and its place in its partition's stream. The
totals of the partitions, one small row each, are turned into global offsets by a prefix sum. Pass two adds
its partition's offset to each document and cuts it at the multiples of ``length``; the pieces are the
boundary records. Only the stream's last sequence can be shorter than ``length``.

The order of the stream is the order of the partitions that pass one saw; pass two reads what pass one
wrote, so a lost executor can't change it.

Defined cases: a null or empty text is the closing id alone; very long texts are whole, each a block of its
own; ids may be null or repeat (ties), every row is packed; an empty table gives no piece; of other columns,
whatever their names, none is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import row_blocks, text_column, trimmed
from tessera.llm._chunkcache import adapter, worker_cache
from tessera.session import materialize, ship


def tokenized(docs: DataFrame, model_path: str, id_col: str, text_col: str, end_id: int, width: int) -> DataFrame:
    """doc_id, part, before (ids before it in its part) and ids (little-endian, of ``width`` bytes) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, before = worker_cache(model_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, offsets = text_column(batch.column(1))
            for i, j in row_blocks(offsets):
                ids, n = cache.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(n)
                out = np.insert(ids, ends, end_id).astype(f"<u{width}")
                n = n + 1
                at = np.concatenate([[0], np.cumsum(n)])
                data = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part), pa.int64()), pa.array(before + at[:-1]), data.cast(pa.binary())], names=["doc_id", "part", "before", "ids"])
                before += int(at[-1])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(encode), f"doc_id {kind}, part long, before long, ids binary")


def cut(place: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first id and size of each piece of runs that begin at ``place`` in the stream."""
    first, last = place // length, (place + n - 1) // length
    pieces = last - first + 1
    doc = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.maximum(0, (first[doc] + nth) * length - place[doc])
    end = np.minimum(n[doc], (first[doc] + nth + 1) * length - place[doc])
    return doc, start, end - start


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian, 16-bit if the vocabulary fits)."""
    spark = docs.sparkSession
    ship(spark)
    width = np.dtype(adapter(model_path)(model_path).dtype).itemsize
    stream = materialize(tokenized(docs, model_path, id_col, text_col, end_id, width), "ids")
    totals = stream.groupBy("part").agg(F.max(F.col("before") + F.length("ids") / width).cast("long").alias("n")).toPandas().sort_values("part")
    sums = np.cumsum(totals["n"].to_numpy(np.int64))
    base = spark.sparkContext.broadcast((totals["part"].to_numpy(np.int64), sums - totals["n"].to_numpy(np.int64)))
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, offsets = base.value
        for batch in batches:
            if not batch.num_rows:
                continue
            place = offsets[np.searchsorted(parts, batch.column(1).to_numpy())] + batch.column(2).to_numpy()
            binary = batch.column(3).cast(pa.large_binary())
            ids, at = id_column(binary, width)
            n = np.diff(at)
            doc, start, size = cut(place, n, length)
            wide = ids.astype("<u4")
            lo = at[doc] + start
            crc = np.fromiter((zlib.crc32(wide[a:b]) for a, b in zip(lo.tolist(), (lo + size).tolist())), np.int64, len(doc))
            where = place[doc] + start
            raw = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((np.append(lo, lo[-1] + size[-1]) * width).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc), pa.array(n[doc]), pa.array(where // length), pa.array(where % length), raw.cast(pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return stream.mapInArrow(trimmed(pieces), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def id_column(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column, and where each row's begin."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(f"<u{width}"), (at - at[0]) // width
