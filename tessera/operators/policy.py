"""Authorization as joins: default deny, per-record denies, and visibility of everything a record refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import StaleView


MAX_BROADCAST = 100_000


def allowed(records: DataFrame, grants: DataFrame, denies: DataFrame, permission: str, principals: list[str] | None = None) -> DataFrame:
    """(principal, record) pairs that may be used: scope and permission granted and the record not denied.

    ``grants``: principal, namespace, permissions (array); ``denies``: principal, id; of the ``principals``, or
    of all. Grants of at most ``MAX_BROADCAST`` rows are broadcast, so that records of one large namespace stay
    where they are; of more, records are spread by their id as well. Denies are an anti-join on (principal, id).
    """
    asked = (lambda df: df) if principals is None else (lambda df: df.filter(F.col("principal").isin(principals)))
    scoped = asked(grants).filter(F.array_contains("permissions", permission)).select("principal", "namespace").distinct()
    refused = asked(denies).select("principal", "id").distinct()
    if scoped.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        pairs = records.join(F.broadcast(scoped), "namespace")
    else:
        salts = 16
        spread = scoped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = records.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["namespace", "_salt"]).drop("_salt")
    return pairs.join(refused, ["principal", "id"], "left_anti")


def closure_visible(records: DataFrame, refs: DataFrame, readable: DataFrame) -> DataFrame:
    """Records that are readable and all of whose references are: ``refs`` (id, ref), ``readable`` (id)."""
    hidden = refs.join(readable.select(F.col("id").alias("ref")), "ref", "left_anti").select("id").distinct()
    return records.join(readable.select("id"), "id", "left_semi").join(hidden, "id", "left_anti")


def quota_usage(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """Use by principal against the smaller of the namespace's and the grant's limit."""
    used = usage.groupBy("principal").agg(F.sum("bytes").alias("used"))
    limit = F.least("namespace_limit", "grant_limit")
    return quotas.join(used, "principal", "left").select("principal", F.coalesce("used", F.lit(0)).cast("long").alias("used"), limit.alias("quota"), (F.coalesce("used", F.lit(0)) > limit).alias("exceeded"))


def replace_policy(current_version: int, expected_version: int, may_manage: bool) -> int:
    """The next version of a policy, if the caller saw the current one and may manage it."""
    if not may_manage:
        raise PermissionError("manage_policy")
    if current_version != expected_version:
        raise StaleView(f"policy version {current_version}, expected {expected_version}")
    return current_version + 1


def check_lease(policy_then: int, policy_now: int, revision_then: int, revision_now: int, pin_revision: bool = False) -> None:
    """A newer policy ends a view; a newer commit ends one that must be current."""
    if policy_now != policy_then or pin_revision and revision_now != revision_then:
        raise StaleView("the view is out of date")
