"""Durable tables: revision log, sorted runs, snapshots with digests, blobs, generated fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Conflict, HistoryUnavailable


class RevisionLog:
    """An append-only log: one directory per revision, so a reader prunes to the revisions it asks for."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def append(self, rows: DataFrame, revision: int) -> None:
        """Write a revision once; a revision that is there already is a conflict."""
        target = f"{self.path}/revision={revision}"
        if self._exists(target + "/_SUCCESS"):
            raise Conflict(f"revision {revision} is committed")
        rows.write.mode("overwrite").parquet(target)

    def read(self, first: int = 1, last: int | None = None, newest_first: bool = False) -> DataFrame:
        """Rows of a range of revisions, in either order."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], f"{self.schema}, revision long")
        rows = self.spark.read.schema(f"{self.schema}, revision long").parquet(self.path).filter(F.col("revision") >= first)
        rows = rows if last is None else rows.filter(F.col("revision") <= last)
        return rows.orderBy(F.desc("revision") if newest_first else "revision")


def write_sorted_run(rows: DataFrame, path: str, *keys: str, parts: int | None = None) -> None:
    """A run sorted by key over range partitions: footer statistics let point and prefix reads skip files."""
    split = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    split.sortWithinPartitions(*keys).write.parquet(path)


def scan_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Keys that begin with a prefix; pushed to the scan."""
    return rows.filter(F.col(key).startswith(prefix))


def predecessor(rows: DataFrame, key: str, at_most: object) -> DataFrame:
    """The row with the largest key of at most a value: a top-1 over a pruned scan."""
    return rows.filter(F.col(key) <= F.lit(at_most)).orderBy(F.desc(key)).limit(1)


def write_snapshot(state: DataFrame, path: str, revision: int) -> str:
    """A snapshot directory of a revision, and the digest of its rows."""
    state.write.mode("overwrite").parquet(f"{path}/snapshot={revision}")
    return _digest(state.sparkSession.read.parquet(f"{path}/snapshot={revision}"))


def load_snapshot(spark: SparkSession, path: str, revision: int, digest: str) -> DataFrame:
    """A snapshot, if its rows still have their digest."""
    rows = spark.read.parquet(f"{path}/snapshot={revision}")
    if _digest(rows) != digest:
        raise HistoryUnavailable(f"snapshot {revision} doesn't match its digest")
    return rows


def _digest(rows: DataFrame) -> str:
    row = F.to_json(F.struct(*sorted(rows.columns)))
    slices = [F.bit_xor(F.conv(F.substring(F.sha2(row, 256), 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    found = rows.agg(*slices, F.count("*").alias("n")).first()
    return ":".join(str(x) for x in found)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, sha256, content)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def blob_range(blobs: DataFrame, offset: int, length: int) -> DataFrame:
    """A range of each blob's bytes; beyond its end it is shorter."""
    return blobs.withColumn("content", F.expr(f"substring(content, {offset + 1}, {length})"))


def stage_blob(spark: SparkSession, chunks: DataFrame, path: str, digest: str) -> str:
    """Finish an upload: ``chunks`` (n, content) must be complete and have the digest; the same one again is fine."""
    rows = chunks.orderBy("n").collect()  # chunks of one upload, at most 16 GiB in 1 MiB chunks in the contract
    if [r["n"] for r in rows] != list(range(len(rows))):
        raise Conflict("a chunk is missing")
    import hashlib

    if hashlib.sha256(b"".join(bytes(r["content"]) for r in rows)).hexdigest() != digest:
        raise Conflict("the content doesn't match its digest")
    chunks.write.mode("overwrite").parquet(f"{path}/blob={digest}")
    return digest


def generate(spark: SparkSession, kind: str, rows: int, seed: int = 42) -> DataFrame:
    """Deterministic fixtures: graph, events, points, observations, bodies."""
    ids = spark.range(rows)
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n))
    made = {
        "graph": lambda: ids.select(F.concat(F.lit("e"), F.col("id")).alias("rel_id"), F.concat(F.lit("n"), draw("src", max(1, rows // 10))).alias("src"), F.concat(F.lit("n"), draw("dst", max(1, rows // 10))).alias("dst"), F.lit("accepted").alias("status")),
        "events": lambda: ids.select((F.col("id") + 1).alias("revision"), F.concat(F.lit("r"), draw("record", max(1, rows // 100))).alias("record"), F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 256).alias("payload")),
        "points": lambda: ids.select("id", (draw("lon", 360_000_000_000) - 180_000_000_000).alias("lon"), (draw("lat", 180_000_000_000) - 90_000_000_000).alias("lat")),
        "observations": lambda: ids.select("id", F.concat(F.lit("u"), draw("entity", max(1, rows // 50))).alias("entity"), draw("at", 1_000_000).alias("at"), (F.col("id") + 1 + F.when(F.col("id") % 20 == 0, 50).otherwise(0)).alias("revision")),
        "bodies": lambda: ids.select("id", draw("p", 1_000_000).alias("p0"), (draw("v", 2_000) - 1_000).alias("v0"), (draw("a", 20) - 10).alias("a")),
    }
    return made[kind]()
