"""Line dedup over levelled sorted runs of line hashes, with DataFrame operations only.

``LineRuns`` holds which document has which line as sorted runs of (line hash, document). A batch of new
documents is merge-anti-joined with the runs, so that a holding which is known already isn't counted again,
and the rest becomes a run of level 0; when a level has ``fanout`` runs they are merged into one of the
next level. Runs are bucketed and sorted by the join's keys, so the anti-joins need no shuffle of the runs,
and a hot line is spread over all buckets, as the document is part of the key.

Line keys are hashed to 128 bits. A line counts with at least ``min_length`` code points after stripping
``[ \\t-\\r]`` and folding A-Z; one found in ``min_docs`` documents or more is dropped from all of them except
the one with the largest id.

Defined cases: a null or empty text is one empty line; ids are integers; a null id is one document, below all others; rows
that repeat an id are one document and each is cleaned; very long texts are whole rows of the lines' table;
extra columns are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import drop_scratch, scratch

KEYS = ("h1", "h2", "doc")
NO_ID = -(1 << 63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z folded."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)


class LineRuns:
    """Levelled sorted runs in the shared folder; ``add`` takes a batch with the columns h1, h2 and doc."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        df.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", scratch(self.spark, "run")).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def table(self) -> DataFrame | None:
        """All holdings, each once."""
        out = None
        for name in self.runs():
            out = self.spark.table(name) if out is None else out.unionByName(self.spark.table(name))
        return out

    def add(self, batch: DataFrame) -> None:
        fresh = batch.select(*KEYS).repartition(self.buckets, *KEYS).dropDuplicates(list(KEYS))
        for name in self.runs():
            run = self.spark.table(name).hint("merge")
            fresh = fresh.join(run, list(KEYS), "left_anti")
        self._write(fresh, 0)
        self._compact()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            names = self.levels[level]
            if len(names) < self.fanout:
                continue
            merged = None
            for name in names:
                merged = self.spark.table(name) if merged is None else merged.unionByName(self.spark.table(name))
            self.levels[level] = []
            self._write(merged.repartition(self.buckets, *KEYS), level + 1)
            for name in names:
                self._forget(name)

    def _forget(self, name: str) -> None:
        location = self.spark.sql(f"describe table extended {name}").filter("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table {name}")
        drop_scratch(self.spark, location)

    def close(self) -> None:
        for name in self.runs():
            self._forget(name)
        self.levels = []


def _repeated(runs: DataFrame, min_docs: int) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 40, min_docs: int = 5, n_batches: int = 4, fanout: int = 3, hot_parts: int = 4096) -> DataFrame:
    """The rows of ``docs`` as a struct ``document``, with n_lines, n_dropped and the text ``kept``.

    Documents go through the runs in ``n_batches`` batches. Lines that hold more than one in ``hot_parts`` of
    all holdings are, by that bound, at most ``hot_parts`` many: they are looked up by a broadcast, all others
    by a join on the hash, where none of them can make up a larger part.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID).cast("long"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = (
        docs.select(ident.alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .filter(F.length("line") >= min_length)
        .select("doc", "row", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_length)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "row", "pos")
    )
    path = scratch(spark, "lines")
    lines.withColumn("batch", F.pmod(F.hash("row"), F.lit(n_batches))).write.partitionBy("batch").parquet(path)
    held = spark.read.schema("h1 long, h2 long, doc long, row long, pos int, batch int").parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    stats_path = scratch(spark, "repeated")
    try:
        for b in range(n_batches):
            runs.add(held.filter(F.col("batch") == b))
        _repeated(runs.table(), min_docs).write.parquet(stats_path)
        total = runs.table().count()
    finally:
        runs.close()  # no table of a run outlives its use, also if a job fails
    repeated = spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(stats_path)
    hot = repeated.filter(F.col("n_docs") * hot_parts > total).select("h1", "h2", F.col("keeper").alias("hot_keeper"))
    cold = repeated.filter(F.col("n_docs") * hot_parts <= total).select("h1", "h2", "keeper")
    marked = held.drop("batch").join(F.broadcast(hot), ["h1", "h2"], "left")
    gone = (
        marked.filter("doc <> hot_keeper").select("doc", "row", "pos")
        .unionByName(marked.filter("hot_keeper is null").join(cold, ["h1", "h2"]).filter("doc <> keeper").select("doc", "row", "pos"))
        .groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    rows = docs.select(F.struct("*").alias("document"), ident.alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = rows.join(gone, ["doc", "row"], "left").select("document", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # the lines between one dropped position and the next; linear in the number of lines
    kept = F.flatten(
        F.transform(
            F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("a"), F.concat("gone", F.array(F.size("lines"))).alias("b")),
            lambda z: F.slice("lines", z["a"] + 2, z["b"] - z["a"] - 1),
        )
    )
    return found.select(
        "document",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("kept"),
    )
