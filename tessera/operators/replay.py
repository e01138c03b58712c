"""Checks of the ordered log, digests of state, snapshots with suffixes, branches, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.asof import latest_at


def revision_gaps(log: DataFrame) -> DataFrame:
    """Revisions that don't follow the one before, as (revision, before).

    A self-join on revision - 1 instead of one global window: no single task sees the whole log.
    """
    least = log.agg(F.min("revision").alias("first"))
    lonely = log.select("revision").distinct().join(log.select((F.col("revision") + 1).alias("revision")).distinct(), "revision", "left_anti")
    return lonely.join(F.broadcast(least)).filter("revision > first").select("revision")


def snapshot_plus_suffix(versions: DataFrame, at: int) -> DataFrame:
    """Current state from a snapshot at a revision and the log after it."""
    return latest_at(latest_at(versions, at).unionByName(versions.filter(F.col("revision") > at).select(latest_at(versions, at).columns)))


def state_digests(rows: DataFrame, key: str, row: str) -> DataFrame:
    """A digest of each key's rows in order; bounded by what one key holds."""
    return rows.groupBy(key).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(row))), 256).alias("digest"))


def content_anchor(rows: DataFrame, by: list[str], row: str) -> DataFrame:
    """XOR of the SHA-256 of rows in four 60-bit slices: the same for any order, and partial sums combine."""
    digest = F.sha2(F.encode(F.col(row), "UTF-8"), 256)
    parts = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    return rows.groupBy(*by).agg(*parts, F.count("*").alias("n"))


def hash_chain(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """The last link of each key's chain: hash(link before, payload), in order."""
    items = F.array_sort(F.collect_list(F.struct(order, payload)))
    return rows.groupBy(key).agg(F.aggregate(items, F.lit(""), lambda a, x: F.sha2(F.concat(a, F.lit("|"), x[payload].cast("string")), 256)).alias("chain"), F.count("*").alias("n"))


def branch_view(base: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """A base view with a branch's rows over it; a row with deleted = true hides its record."""
    return base.join(overlay.select(key), key, "left_anti").unionByName(overlay.filter("not deleted").select(base.columns))


def promotion_conflicts(base_then: DataFrame, base_now: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """Records of a branch whose base version moved on since the branch began."""
    then, now = base_then.select(key, F.col("version").alias("then")), base_now.select(key, F.col("version").alias("now"))
    return overlay.select(key).join(then, key, "left").join(now, key, "left").filter(~F.col("then").eqNullSafe(F.col("now")))


def percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95, p99 by group."""
    return rows.groupBy(*by).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.count("*").alias("n"))


def corrected_summaries(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums by time bucket over the last correction of each observation."""
    last = Window.partitionBy("event").orderBy(F.desc("revision"), F.desc("id"))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
