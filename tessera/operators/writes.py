"""Validation of writes and derivation of version rows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.asof import TRANSITIONS, latest_at
from tessera.session import materialize

MAX_BROADCAST = 1_000_000
STATUSES = ("proposed", "accepted", "rejected", "disputed", "superseded", "retracted", "expired")


def transition_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "status string, operation string, new_status string")


def apply_transitions(claims: DataFrame, operations: DataFrame) -> DataFrame:
    """Outcome of one operation per claim: ``operations`` (id, operation). The table has a fixed six rows."""
    rows = operations.join(claims.select("id", "status"), "id", "left").join(F.broadcast(transition_table(claims.sparkSession)), ["status", "operation"], "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("new_status").isNull(), "invalid_transition").otherwise("ok")
    return rows.select("id", "operation", "status", F.coalesce("new_status", "status").alias("new_status"), outcome.alias("outcome"))


def duplicate_mutations(operations: DataFrame) -> DataFrame:
    """Records that a transaction touches more than once."""
    return operations.groupBy("txn", "id").agg(F.count("*").alias("n")).filter("n > 1")


def transaction_bounds(operations: DataFrame, max_operations: int = 10_000, max_references: int = 100_000) -> DataFrame:
    """Operations and references by transaction, and whether they are within the limits."""
    sums = operations.groupBy("txn").agg(F.count("*").alias("operations"), F.sum("refs").cast("long").alias("refs"))
    return sums.withColumn("ok", (F.col("operations") <= max_operations) & (F.col("refs") <= max_references))


def closure_violations(claims: DataFrame, endpoints: DataFrame | None, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Why claims may not stand: no evidence, evidence that is missing or named twice, endpoints not active.

    ``claims`` (id, status, evidence array), ``endpoints`` (id, entity). Endpoints matter while a claim is
    proposed or accepted. Without ``endpoints`` claims hold them as an array, ends, and aren't joined with themselves.
    What isn't there is found once for each name, and claims are joined with that, which is little, not with all that is there.
    """
    none = claims.filter(F.size("evidence") == 0).select("id", F.lit("no_evidence").alias("reason"))
    twice = claims.filter(F.size("evidence") != F.size(F.array_distinct("evidence"))).select("id", F.lit("duplicate_evidence").alias("reason"))
    missing = _of_absent(claims.select("id", F.explode("evidence").alias("ref")), evidence).select("id", F.lit("missing_evidence").alias("reason"))
    live = claims.filter("status in ('proposed', 'accepted')")
    ends = live.select("id", F.explode("ends").alias("ref")) if endpoints is None else endpoints.select("id", F.col("entity").alias("ref")).join(live.select("id"), "id", "left_semi")
    dead = _of_absent(ends, entities.filter("lifecycle = 'active'")).select("id", F.lit("inactive_endpoint").alias("reason"))
    return none.unionByName(twice).unionByName(missing).unionByName(dead).distinct()


def _of_absent(refs: DataFrame, there: DataFrame) -> DataFrame:
    """Rows (id, ref) whose ref isn't the id of a row of ``there``; absent names are broadcast up to ``MAX_BROADCAST``, else joined."""
    absent = materialize(refs.select("ref").distinct().join(there.select(F.col("id").alias("ref")), "ref", "left_anti"), "absent")
    few = absent.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    null = refs.filter("ref is null")
    return refs.join(F.broadcast(absent) if few else absent, "ref", "left_semi").select("id", "ref").unionByName(null.select("id", "ref"))


def delete_dependents(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """What deleting each entity would need: dependents by status and whether a plain delete is refused."""
    live = edges.filter("status in ('accepted', 'proposed')")
    ends = live.select(F.col("src").alias("id"), "rel_id", "status").unionByName(live.filter("src <> dst").select(F.col("dst").alias("id"), "rel_id", "status"))
    sums = ends.groupBy("id").agg(F.count(F.when(F.col("status") == "accepted", 1)).alias("accepted"), F.count(F.when(F.col("status") == "proposed", 1)).alias("proposed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = targets.select("id").join(sums, "id", "left").select("id", zero("accepted"), zero("proposed"))
    return out.withColumn("outcome", F.when(F.col("accepted") + F.col("proposed") == 0, "deleted").when(F.col("proposed") > 0, "cascade_refused").otherwise("cascade_needed"))


def cascade_retract(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edge table after deleting ``targets`` (id) with a cascade: their accepted relationships are retracted."""
    gone = edges.filter("status = 'accepted'").select("rel_id", F.explode(F.array("src", "dst")).alias("id")).join(targets.select("id"), "id", "left_semi").select("rel_id").distinct().withColumn("_gone", F.lit(True))
    return edges.join(gone, "rel_id", "left").withColumn("status", F.when(F.col("_gone"), "retracted").otherwise(F.col("status"))).drop("_gone")


def replace_entities(versions: DataFrame, replacements: DataFrame, revision: int) -> DataFrame:
    """Version rows of whole replacements (id, payload) of active entities; others are refused by absence."""
    now = latest_at(versions).filter("lifecycle = 'active'").select("id", "kind", "version", "lifecycle")
    return replacements.join(now, "id").select("id", "kind", (F.col("version") + 1).alias("version"), F.lit(revision).cast("long").alias("revision"), "lifecycle", "payload")


def correct_claims(claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """New proposed claims that correct accepted ones; the corrected stay as they are."""
    return corrections.join(claims.filter("status = 'accepted'").select(F.col("id").alias("correction_of")), "correction_of", "left_semi").withColumn("status", F.lit("proposed"))


def index_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of an index that differ from what it should hold: empty if it is right."""
    return stored.exceptAll(recomputed).withColumn("side", F.lit("stored")).unionByName(recomputed.exceptAll(stored).withColumn("side", F.lit("expected")))


def idempotent_outcomes(requests: DataFrame, committed: DataFrame) -> DataFrame:
    """Outcome of requests (principal, key, digest, at) against commits (principal, key, digest, txn, expires)."""
    known = committed.select("principal", "key", F.col("digest").alias("_digest"), "txn", "expires")
    rows = requests.join(known, ["principal", "key"], "left")
    outcome = F.when(F.col("_digest").isNull(), "new").when(F.col("at") > F.col("expires"), "expired").when(F.col("_digest") == F.col("digest"), "replayed").otherwise("conflict")
    return rows.select("principal", "key", outcome.alias("outcome"), F.when(outcome == "replayed", F.col("txn")).alias("txn"))


def commit_outcome(commits: DataFrame, principal: str, key: str) -> DataFrame:
    """A principal's own commit under a key; another principal's isn't there."""
    return commits.filter((F.col("principal") == principal) & (F.col("key") == key))
