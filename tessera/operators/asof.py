"""Records as of a revision, their history, and predicates over two time axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import HistoryUnavailable, UnknownReadView
from tessera.session import materialize

TRANSITIONS = (
    ("proposed", "accept", "accepted"), ("proposed", "reject", "rejected"), ("accepted", "dispute", "disputed"),
    ("accepted", "supersede", "superseded"), ("accepted", "retract", "retracted"), ("accepted", "expire", "expired"),
)


def latest_at(versions: DataFrame, revision: int | None = None, key: tuple[str, ...] = ("id",), order: str = "revision") -> DataFrame:
    """The last version of each record with a revision of at most ``revision``; None is the current state.

    One aggregation with map-side combine: no sort of the history and one row per record in the shuffle.
    """
    rows = versions if revision is None else versions.filter(F.col(order) <= revision)
    rest = [c for c in versions.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return best.select(*key, "_last.*")


def current_revision(versions: DataFrame, order: str = "revision") -> int:
    return versions.agg(F.coalesce(F.max(order), F.lit(0))).first()[0]


def resolve_revision(versions: DataFrame, revision: int | None, retained_from: int = 1, order: str = "revision") -> int:
    """The revision to read at, or a typed error."""
    now = current_revision(versions, order)
    if revision is None:
        return now
    if revision > now:
        raise UnknownReadView(f"revision {revision}, current {now}")
    if revision < retained_from:
        raise HistoryUnavailable(f"revision {revision}, retained from {retained_from}")
    return revision


def record_at(versions: DataFrame, ident: str, revision: int | None = None) -> DataFrame:
    """One record as of a revision; a revision that is yet to come is an error, not an empty answer."""
    return latest_at(versions.filter(F.col("id") == ident), resolve_revision(versions, revision))


def visible(records: DataFrame) -> DataFrame:
    """Entities must be active; other records are always visible."""
    return records.filter((F.col("kind") != "entity") | (F.col("lifecycle") == "active"))


def history(versions: DataFrame, order: str = "revision") -> DataFrame:
    """All versions with the revision that ends each (null: still holds)."""
    return versions.withColumn("until", F.lead(order).over(Window.partitionBy("id").orderBy(order)))


def valid_at(kind: Column, start: Column, end: Column, instant: Column) -> Column:
    """Three-valued: null if the valid time is unknown; a null bound is unbounded; half-open."""
    return F.when(kind == "unknown", None).otherwise((start.isNull() | (instant >= start)) & (end.isNull() | (instant < end)))


def interval_ok(kind: Column, start: Column, end: Column) -> Column:
    """Two bounds must leave a time between them."""
    return (kind == "unknown") | start.isNull() | end.isNull() | (start < end)


def bitemporal(versions: DataFrame, revision: int, instant: Column) -> DataFrame:
    """What was known at a revision, with whether it held at an instant (null: unknown)."""
    known = latest_at(versions, revision)
    return known.withColumn("holds", valid_at(F.col("valid_kind"), F.col("valid_start"), F.col("valid_end"), instant))


def contradictions(claims: DataFrame) -> DataFrame:
    """Subjects and predicates with more than one accepted object; all are preserved."""
    return claims.filter("status = 'accepted'").groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("objects")).filter(F.size("objects") > 1)


def correction_chains(claims: DataFrame) -> DataFrame:
    """Each claim with the root of its chain of corrections, its depth and an outcome; chains are single-parent.

    Chains of any depth end ``ok``, those that lead to a claim that isn't there are ``missing`` (with its id as the
    root), those in or into a ``cycle`` have no root. By pointer doubling: each round, written to the shared folder,
    doubles the steps taken, so what the bit length of the number of claims leaves open is a cycle.
    """
    parent = F.col("correction_of")
    first = claims.select("id", F.coalesce(parent, F.col("id")).alias("root"), F.when(parent.isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(parent.isNull(), "ok").alias("outcome"))
    known = materialize(first, "chains")
    done, now = known.filter("outcome is not null"), known.filter("outcome is null")
    for _ in range(known.count().bit_length()):
        if now.isEmpty():
            break
        jump = done.unionByName(now).select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.coalesce("outcome", F.lit("open")).alias("_outcome"))
        outcome = F.when(F.col("_outcome").isNull(), "missing").when(F.col("_outcome") != "open", F.col("_outcome"))
        step = now.join(jump, "root", "left").select("id", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), outcome.alias("outcome"))
        step = materialize(step, "chains")
        done, now = done.unionByName(step.filter("outcome is not null")), step.filter("outcome is null")
    return done.unionByName(now.select("id", F.lit(None).cast(claims.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("outcome")))


def read_view_outcomes(checks: DataFrame, versions: DataFrame) -> DataFrame:
    """Predicates (absent, visible, version) of ``checks`` at their revision and now, and what a write gets.

    ``checks``: check_id, id, predicate, version, at. An absent record has no version at all; a deleted one
    isn't absent. Errors are told apart by the order of the cases.
    """
    now = current_revision(versions)
    rows = versions.select("id", "version", "revision", "lifecycle")
    last = lambda condition, name: F.max_by(F.when(condition, F.struct("version", "lifecycle")), F.when(condition, F.col("revision"))).alias(name)
    seen = checks.join(rows.withColumnsRenamed({"version": "_v"}).select("id", F.col("_v").alias("version_held"), "revision", "lifecycle"), "id", "left").withColumnRenamed("version", "wanted").withColumnRenamed("version_held", "version")
    state = seen.groupBy("check_id", "id", "predicate", "wanted", "at").agg(last(F.col("revision") <= F.col("at"), "then"), last(F.col("revision").isNotNull(), "now"))
    holds = lambda s: F.when(F.col("predicate") == "absent", s.isNull()).when(F.col("predicate") == "visible", F.coalesce(s["lifecycle"] == "active", F.lit(False))).otherwise(F.coalesce(s["version"] == F.col("wanted"), F.lit(False)))
    then, current = holds(F.col("then")), holds(F.col("now"))
    outcome = F.when(F.col("at") > now, "unknown_read_view").when(~then, "predicate_failed").when(~current, "read_view_changed").otherwise("ok")
    return state.select("check_id", "id", "predicate", then.alias("held_then"), current.alias("holds_now"), outcome.alias("outcome"))
