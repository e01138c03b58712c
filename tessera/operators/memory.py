"""Source-cited facts and claims: eligibility at a revision, links, citations, folds of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import byte_slice, effective_support, sha256_hex


def eligible_facts(facts: DataFrame, sources: DataFrame, revision: int, denied: DataFrame | None = None) -> DataFrame:
    """Facts that may be answered at a revision.

    A fact must be recorded and not yet ended; its source version recorded, not superseded by then, and never
    revoked, at any time: revocation reaches back, supersession doesn't. ``denied`` (id) hides facts, sources
    and facts with a hidden link.
    """
    live = facts.filter((F.col("recorded") <= revision) & (F.col("terminal_revision").isNull() | (F.col("terminal_revision") > revision)))
    good = sources.filter((F.col("recorded") <= revision) & F.col("revoked").isNull() & (F.col("superseded").isNull() | (F.col("superseded") > revision))).select("source", "version")
    out = live.join(good, ["source", "version"], "left_semi")
    if denied is not None:
        hidden = denied.select("id").distinct()
        linked = out.select("id", F.explode("links").alias("link")).join(hidden.withColumnRenamed("id", "link"), "link", "left_semi").select("id").distinct()
        out = out.join(hidden, "id", "left_anti").join(hidden.withColumnRenamed("id", "source"), "source", "left_anti").join(linked, "id", "left_anti")
    return out


def source_versions_at(sources: DataFrame, revision: int) -> DataFrame:
    """Source versions recorded by a revision: supersession shows only once it happened, revocation always."""
    superseded = F.when(F.col("superseded") <= revision, F.col("superseded"))
    return sources.filter(F.col("recorded") <= revision).select("source", "version", "recorded", superseded.alias("superseded"), "revoked")


def fact_links(facts: DataFrame, eligible: DataFrame) -> DataFrame:
    """One hop along stored links in stored order; links to facts that aren't eligible are passed over."""
    steps = facts.select("id", F.posexplode("links").alias("position", "linked"))
    return steps.join(eligible.select(F.col("id").alias("linked")), "linked", "left_semi").select("id", "position", "linked")


def edges_from(edges: DataFrame, denied: DataFrame, kind: str | None = None, revision: int | None = None, max_candidates: int | None = None, max_results: int | None = None) -> DataFrame:
    """Research edges whose own id, target and asserting record are all readable, optionally of one kind.

    As of ``revision``, if given (column recorded). With limits, which count by record that edges come from and
    in the order of ids, there is a column ``truncated``: more candidates, or more readable edges, than allowed.
    Candidates are counted before kinds and denies are looked at, so that a denied edge isn't told from none.
    """
    rows = edges if revision is None else edges.filter(F.col("recorded") <= revision)
    by, whole = Window.partitionBy("from").orderBy("id"), Window.partitionBy("from")
    more = F.lit(False)
    if max_candidates is not None:
        rows = rows.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= max_candidates + 1)
        rows = rows.withColumn("_more", F.max("_k").over(whole) > max_candidates).filter(F.col("_k") <= max_candidates)
        more = F.col("_more")
    rows = rows if kind is None else rows.filter(F.col("kind") == kind)
    hidden = denied.select("id").distinct()
    for c in ("id", "to", "asserted_by"):
        rows = rows.join(hidden.select(F.col("id").alias(c)), c, "left_anti")
    if max_results is not None:
        rows = rows.withColumn("_j", F.row_number().over(by)).filter(F.col("_j") <= max_results + 1)
        rows = rows.withColumn("_over", F.max("_j").over(whole) > max_results).filter(F.col("_j") <= max_results)
        more = more | F.col("_over")
    return rows if max_candidates is None and max_results is None else rows.withColumn("truncated", more).drop("_k", "_more", "_j", "_over")


VIEWS = {
    "fact": ["id", "subject", "predicate", "value", "recorded"],
    "claim": ["id", "subject", "predicate", "value", "recorded", "terminal_revision"],
    "source": ["source", "version", "recorded", "superseded", "revoked"],
    "citation": ["id", "source", "version", "start", "end"],
}


def project(rows: DataFrame, view: str, revision: int | None = None) -> DataFrame:
    """The public columns of a kind of record, as of a revision: what ended later is still open."""
    shown = rows if revision is None or "recorded" not in rows.columns else rows.filter(F.col("recorded") <= revision)
    later = {"terminal_revision", "superseded", "revoked"} if revision is not None else set()
    return shown.select(*[F.when(F.col(c) <= revision, F.col(c)).alias(c) if c in later else F.col(f"`{c}`") for c in VIEWS[view]])


def byte_accounts(excerpts: DataFrame, key: str, fields: int = 0) -> DataFrame:
    """Accounted bytes by record: its fields, and every excerpt with its frame; texts are neither collected nor shuffled."""
    return excerpts.groupBy(key).agg((F.lit(128 + fields) + F.sum(64 + F.octet_length("excerpt"))).cast("long").alias("bytes"))


def resolve_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """The exact bytes that each citation names, its digest, and whether it may be shown."""
    found = citations.join(sources.select("source", "version", "text", "revoked"), ["source", "version"])
    excerpt = byte_slice(F.col("text"), F.col("start"), F.col("end"))
    fits = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.octet_length("text"))
    outcome = F.when(F.col("revoked").isNotNull(), "withheld").when(~fits, "out_of_range").when(excerpt.isNull(), "not_a_boundary").otherwise("resolved")
    shown = outcome == "resolved"
    return found.select("id", "source", "version", outcome.alias("outcome"), F.when(shown, excerpt).alias("excerpt"), F.when(shown, sha256_hex(excerpt)).alias("excerpt_sha256"), F.when(shown, F.octet_length(excerpt) + 160).cast("long").alias("bytes"))


def claim_support(claims: DataFrame, citations: DataFrame, sources: DataFrame, denied: DataFrame) -> DataFrame:
    """Effective support of each claim from its visible citations."""
    seen = citations.join(denied.select(F.col("id").alias("source")).distinct(), "source", "left_anti").join(sources.select("source", "version", "revoked"), ["source", "version"])
    sums = seen.groupBy("id").agg(F.count("*").alias("visible"), F.count("revoked").alias("revoked"), F.max("revoked").alias("last"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return claims.join(sums, "id", "left").select("id", effective_support(F.col("support"), zero("visible"), zero("revoked"), F.col("last")).alias("effective"))


def fold_facts(mutations: DataFrame) -> DataFrame:
    """State of facts after ordered mutations (revision, id, op: put, correct, retract; corrects).

    A correction supersedes what it corrects at its own revision; a retraction ends its fact; a terminal fact
    can't be touched again, so the first ending counts.
    """
    put = mutations.filter("op in ('put', 'correct')").select("id", F.col("revision").alias("recorded"), "corrects")
    ends = mutations.filter("op = 'correct'").select(F.col("corrects").alias("id"), "revision", F.lit("superseded").alias("terminal")).unionByName(mutations.filter("op = 'retract'").select("id", "revision", F.lit("retracted").alias("terminal")))
    first = ends.groupBy("id").agg(F.min(F.struct("revision", "terminal")).alias("e")).select("id", F.col("e.revision").alias("terminal_revision"), F.col("e.terminal").alias("terminal"))
    return put.join(first, "id", "left")


def fold_sources(mutations: DataFrame) -> DataFrame:
    """Source versions with the revision of the version after them: put in order, versions contiguous."""
    by = Window.partitionBy("source").orderBy("version")
    return mutations.select("source", "version", F.col("revision").alias("recorded"), F.lead("revision").over(by).alias("superseded"), (F.col("version") == F.row_number().over(by)).alias("contiguous"))


def map_pilot_links(facts: DataFrame) -> DataFrame:
    """Links of facts as related edges with ids derived from both ends."""
    return facts.select(F.col("id").alias("from"), F.explode("links").alias("to")).select(F.substring(F.sha2(F.concat_ws("|", F.lit("related"), "from", "to"), 256), 1, 32).alias("id"), F.lit("related").alias("kind"), "from", "to")


def fold_claims(mutations: DataFrame) -> DataFrame:
    """Status of claims after ordered mutations (revision, id, op, corrects).

    ops: put, retract, expire, revoke. A put that corrects an active claim supersedes it at its own revision;
    the first ending of a claim counts, so a correction of an ended claim leaves that as it was.
    """
    puts = mutations.filter("op = 'put'").select("id", F.col("revision").alias("recorded"), "corrects")
    names = F.create_map(*[F.lit(x) for x in ("retract", "retracted", "expire", "expired", "revoke", "revoked", "put", "superseded")])
    target = F.when(F.col("op") == "put", F.col("corrects")).otherwise(F.col("id"))
    ends = mutations.select(target.alias("id"), "revision", names[F.col("op")].alias("status")).filter("id is not null")
    first = ends.groupBy("id").agg(F.min_by("status", "revision").alias("status"), F.min("revision").alias("status_revision"))
    return puts.join(first, "id", "left").select("id", "recorded", F.coalesce("status", F.lit("active")).alias("status"), "status_revision")


def unified_versions(tables: dict[str, DataFrame]) -> DataFrame:
    """All versions of all tables in canonical order: (family, id, version, recorded)."""
    out = None
    for name in sorted(tables):
        rows = tables[name].select(F.lit(name).alias("family"), F.col("id").cast("string").alias("id"), F.col("version").cast("long").alias("version"), F.col("recorded").cast("long").alias("recorded"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("family", "id", "version")
