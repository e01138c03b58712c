"""Queries over policy history, catalogs, contracts, containers and streams."""

from __future__ import annotations

import io
import tarfile
import wave
import zipfile

from pyspark.sql import functions as F

from tessera.contract import WriteContract
from tessera.errors import EngineError, HistoryUnavailable, ResultLimit, UnknownReadView
from tessera.operators import asof, graph, ingest, memory, policy, space, writes
from tessera.plans.record_queries import last, late, late_of
from tessera.plans.registry import query
from tessera.session import scratch
from tessera.sources import tables
from tessera.streaming import feeds

POLICIES = "(SELECT 'ns' || CAST(user_id % 20 AS STRING) AS id, event_id + 1 AS revision, event_type AS body FROM {events} WHERE event_id % 5 = 0)"


@query("policy_at_revision", f"SELECT id, revision, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS k FROM {POLICIES} p WHERE revision <= 600) WHERE k = 1")
def policy_at_revision(spark, m):
    rows = m["events"].filter("event_id % 5 = 0").select(F.concat(F.lit("ns"), F.col("user_id") % 20).alias("id"), (F.col("event_id") + 1).alias("revision"), F.col("event_type").alias("body"))
    return asof.latest_at(rows, 600)


@query("policy_replace", "SELECT * FROM (VALUES ('ok', 4), ('stale', -1), ('denied', -1)) v(name, version)")
def policy_replace(spark, m):
    out = []
    for name, args in (("ok", (3, 3, True)), ("stale", (3, 2, True)), ("denied", (3, 3, False))):
        try:
            out.append((name, policy.replace_policy(*args)))
        except (EngineError, PermissionError):
            out.append((name, -1))
    return spark.createDataFrame(out, "name string, version int")


@query("lease_revalidation", "SELECT * FROM (VALUES ('same', true), ('new policy', false), ('new commit', true), ('new commit, pinned', false)) v(name, ok)")
def lease_revalidation(spark, m):
    out = []
    for name, args in (("same", (1, 1, 5, 5)), ("new policy", (1, 2, 5, 5)), ("new commit", (1, 1, 5, 6)), ("new commit, pinned", (1, 1, 5, 6, True))):
        try:
            policy.check_lease(*args)
            out.append((name, True))
        except EngineError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, ok boolean")


@query("knowledge_resolution", "SELECT 'current' AS name, max(event_id) + 1 AS revision FROM {events} UNION ALL SELECT 'past', 100 UNION ALL SELECT 'unretained', -1 UNION ALL SELECT 'future', -2")
def knowledge_resolution(spark, m):
    out = []
    for name, revision, retained in (("current", None, 1), ("past", 100, 1), ("unretained", 5, 50), ("future", 1 << 40, 1)):
        try:
            out.append((name, asof.resolve_revision(m["user_versions"], revision, retained)))
        except HistoryUnavailable:
            out.append((name, -1))
        except UnknownReadView:
            out.append((name, -2))
    return spark.createDataFrame(out, "name string, revision long")


@query("result_limit", "SELECT * FROM (VALUES (10, true), (1000000000, false)) v(max_rows, refused)")
def result_limit(spark, m):
    out = []
    for limit in (10, 1_000_000_000):
        try:
            graph.limited(graph.directed(m["placed"], "out"), limit)
            out.append((limit, False))
        except ResultLimit:
            out.append((limit, True))
    return spark.createDataFrame(out, "max_rows int, refused boolean")


@query("spatial_as_of", """SELECT 'geo' || CAST(k AS STRING) AS id, CAST(2 AS BIGINT) AS version, CASE WHEN r <= 700 THEN 'found' ELSE 'missing' END AS outcome
    FROM range(0, 120) t(k) LEFT JOIN (SELECT CAST(split_part(id, ':', 2) AS BIGINT) AS u, revision AS r FROM {user_versions} WHERE version = 2) ON u = k""")
def spatial_as_of(spark, m):
    rows = m["user_versions"].select(F.concat(F.lit("geo"), F.split_part("id", F.lit(":"), F.lit(2))).alias("id"), "version", F.col("revision").alias("recorded"))
    wanted = spark.range(120).select(F.concat(F.lit("geo"), "id").alias("id"), F.lit(2).cast("long").alias("version"))
    return space.catalog_at(rows, 700, wanted)


@query("observation_at", "SELECT id, entity, x, y FROM {observations} WHERE revision <= (SELECT max(revision) * 9 // 10 FROM {observations})")
def observation_at(spark, m):
    at = asof.current_revision(m["observations"]) * 9 // 10
    return space.observations_at(m["observations"], at).select("id", "entity", "x", "y")


@query("version_visit", """SELECT 'facts' AS family, id, CAST(1 AS BIGINT) AS version, recorded FROM {facts} UNION ALL SELECT 'sources', source, version, recorded FROM {sources} UNION ALL SELECT 'users', id, version, revision FROM {user_versions}""")
def version_visit(spark, m):
    return memory.unified_versions({
        "users": m["user_versions"].withColumnRenamed("revision", "recorded"), "sources": m["sources"].withColumnRenamed("source", "id"),
        "facts": m["facts"].withColumn("version", F.lit(1)),
    })


@query("spatial_batch_validation", """SELECT id, version, reason FROM (
    SELECT k AS id, CAST(CASE WHEN k % 7 = 0 THEN 3 ELSE 2 END AS BIGINT) AS version, CASE WHEN k % 7 = 0 THEN 'version_gap' END AS reason FROM range(0, 200) t(k) WHERE k % 7 = 0
    UNION ALL SELECT k, CAST(CASE WHEN k % 7 = 0 THEN 3 ELSE 2 END AS BIGINT), 'missing_frame' FROM range(0, 200) t(k) WHERE k % 11 = 0
    UNION ALL SELECT k, CAST(CASE WHEN k % 7 = 0 THEN 3 ELSE 2 END AS BIGINT), 'bad_correction' FROM range(0, 200) t(k) WHERE k % 13 = 0)""")
def spatial_batch_validation(spark, m):
    k = F.col("id")
    catalog = spark.range(200).select("id", F.lit(1).cast("long").alias("version"), (k % 10).alias("entity"))
    batch = spark.range(200).select("id", F.when(k % 7 == 0, 3).otherwise(2).cast("long").alias("version"), F.when(k % 11 == 0, 9_999).otherwise(0).cast("long").alias("frame"), F.when(k % 13 == 0, F.when(k % 2 == 0, k - k % 10 + (k + 1) % 10).otherwise(9_999)).cast("long").alias("correction_of"), (k % 10).alias("entity"))
    return space.batch_violations(batch, catalog)


@query("fold_claims", """WITH e AS (SELECT event_id AS k, event_id + 1 AS r FROM {events}), p AS (SELECT k AS id, r AS recorded, CASE WHEN k % 10 = 4 THEN k - 3 END AS corrects FROM e WHERE k % 10 < 6),
    t AS (SELECT corrects AS id, recorded AS r, 'superseded' AS s FROM p WHERE corrects IS NOT NULL UNION ALL SELECT k - 6, r, 'retracted' FROM e WHERE k % 10 = 7 UNION ALL SELECT k - 8, r, 'expired' FROM e WHERE k % 10 = 8 UNION ALL SELECT k - 6, r, 'revoked' FROM e WHERE k % 10 = 9)
    SELECT id, recorded, coalesce(s, 'active') AS status, r AS status_revision FROM p LEFT JOIN (SELECT id, arg_min(s, r) AS s, min(r) AS r FROM t GROUP BY id) USING (id)""")
def fold_claims(spark, m):
    k, d = F.col("event_id"), F.col("event_id") % 10
    rows = m["events"].filter(d != 6).select(F.when(d == 7, k - 6).when(d == 8, k - 8).when(d == 9, k - 6).otherwise(k).alias("id"), (k + 1).alias("revision"), F.when(d == 7, "retract").when(d == 8, "expire").when(d == 9, "revoke").otherwise("put").alias("op"), F.when(d == 4, k - 3).alias("corrects"))
    return memory.fold_claims(rows)


@query("write_contract", "SELECT * FROM (VALUES (1, 1, false), (2, 2, false), (3, 2, true), (4, 3, false), (5, -1, false), (6, -1, false)) v(step, revision, replayed)")
def write_contract(spark, m):
    c, out = WriteContract(), []
    c.negotiate([(1, 0), (2, 0)])
    steps = [("a", "begin_rebuild", {}, 0), ("b", "put_source", {"source": "s"}, 1), ("b", "put_source", {"source": "s"}, 1), ("c", "complete_rebuild", {}, 1), ("b", "put_source", {"source": "t"}, 1), ("d", "put_fact", {}, 0)]
    for i, (key, kind, body, generation) in enumerate(steps, 1):
        try:
            r = c.write("p", key, kind, body, generation)
            out.append((i, r.revision, r.replayed))
        except EngineError:
            out.append((i, -1, False))
    return spark.createDataFrame(out, "step int, revision int, replayed boolean")


@query("create_records", "SELECT 'order:' || CAST(o_orderkey AS STRING) AS id, CAST(1 AS BIGINT) AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'proposed' ELSE 'active' END AS state FROM {orders}")
def create_records(spark, m):
    claim = F.col("o_orderkey") % 2 == 0
    return m["orders"].select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.lit(1).cast("long").alias("version"), F.when(claim, writes.STATUSES[0]).otherwise("active").alias("state"))


@query("fact_projection", f"SELECT id, subject, predicate, value, recorded FROM {{facts}} WHERE recorded <= {late('facts', 'recorded')}")
def fact_projection(spark, m):
    return memory.project(m["facts"], "fact", late_of(m["facts"], "recorded"))


@query("claim_projection", f"SELECT id, subject, predicate, value, recorded, CASE WHEN terminal_revision <= {late('facts', 'recorded')} THEN terminal_revision END AS terminal_revision FROM {{facts}} WHERE recorded <= {late('facts', 'recorded')}")
def claim_projection(spark, m):
    return memory.project(m["facts"], "claim", late_of(m["facts"], "recorded"))


@query("source_projection", f"SELECT source, version, recorded, CASE WHEN superseded <= {late('sources', 'recorded')} THEN superseded END AS superseded, CASE WHEN revoked <= {late('sources', 'recorded')} THEN revoked END AS revoked FROM {{sources}} WHERE recorded <= {late('sources', 'recorded')}")
def source_projection(spark, m):
    return memory.project(m["sources"], "source", late_of(m["sources"], "recorded"))


@query("fan_out_statistics", "SELECT max(n) AS widest, count(*) AS ends, CAST(sum(n) AS BIGINT) AS links FROM (SELECT src, count(*) AS n FROM {contains} GROUP BY src)")
def fan_out_statistics(spark, m):
    return m["contains"].groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n").alias("widest"), F.count("*").alias("ends"), F.sum("n").alias("links"))


@query("xml_adapter", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 9 = 0 THEN 'malformed' ELSE 'complete' END AS outcome FROM {events}")
def xml_adapter(spark, m):
    good = F.concat(F.lit("<e><user_id>"), F.col("user_id").cast("string"), F.lit("</user_id></e>"))
    rows = m["events"].select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("<e><user_id>")).otherwise(good).alias("raw"))
    return ingest.xml_rows(rows, "raw", "user_id long").select("event_id", "user_id", "outcome")


@query("container_adapter", "SELECT * FROM (VALUES ('a.zip', 'x.txt', 5, 'complete'), ('a.zip', 'y.txt', 2, 'complete'), ('b.tar', 'z', 3, 'complete'), ('c.wav', 'frames', 4, 'complete'), ('d.zip', NULL, NULL, 'malformed'), ('e.pdf', NULL, NULL, 'unsupported')) v(name, member, size, outcome)")
def container_adapter(spark, m):
    files = {"d.zip": b"not a zip", "e.pdf": b"%PDF-1.7"}
    with zipfile.ZipFile(z := io.BytesIO(), "w") as f:
        f.writestr("x.txt", "12345")
        f.writestr("y.txt", "12")
    with tarfile.open(fileobj=(t := io.BytesIO()), mode="w") as f:
        info = tarfile.TarInfo("z")
        info.size = 3
        f.addfile(info, io.BytesIO(b"abc"))
    with wave.open(w := io.BytesIO(), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8_000)
        f.writeframes(b"\0" * 8)
    files |= {"a.zip": z.getvalue(), "b.tar": t.getvalue(), "c.wav": w.getvalue()}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary")
    return ingest.container_members(rows)


@query("blob_range_read", "SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS length, lower(hex(b)) AS bytes FROM (SELECT doc_id, CAST(unhex(substr(hex(encode(text)), 21, 32)) AS BLOB) AS b FROM {documents})")
def blob_range_read(spark, m):
    blobs = m["documents"].select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return tables.blob_range(blobs, 10, 16).select("doc_id", F.length("content").cast("long").alias("length"), F.lower(F.hex("content")).alias("bytes"))


def _event_log(spark, m, parts: int = 4) -> str:
    path = scratch(spark, "feed")
    log = tables.RevisionLog(spark, path, "event_id long, user_id long")
    for r in range(1, parts + 1):
        log.append(m["events"].filter(F.col("event_id") % parts == r - 1).select("event_id", "user_id"), r)
    return path


@query("change_subscription", "SELECT event_id, event_id % 4 + 1 AS revision FROM {events} WHERE event_id % 4 + 1 > 2")
def change_subscription(spark, m):
    out = scratch(spark, "changes")
    rows = feeds.subscribe(spark, _event_log(spark, m), "event_id long, user_id long", cursor=2)
    rows.select("event_id", "revision").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("stream_import", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(event_id) AS BIGINT) AS total FROM {events}")
def stream_import(spark, m):
    target, ledger = scratch(spark, "target"), scratch(spark, "ledger")
    rows = feeds.subscribe(spark, _event_log(spark, m), "event_id long, user_id long", max_files=8)
    feeds.import_stream(rows, target, ledger, scratch(spark, "check"), "job").awaitTermination()
    noted = spark.read.parquet(ledger).select(F.col("rows").alias("n_rows"), F.lit(0).cast("long").alias("total"))
    return noted.unionByName(spark.read.parquet(target).select(F.lit(0).cast("long").alias("n_rows"), F.col("event_id").alias("total"))).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"))


@query("stream_distinct", "SELECT DISTINCT user_id FROM {events}")
def stream_distinct(spark, m):
    out = scratch(spark, "distinct")
    rows = feeds.distinct_events(feeds.subscribe(spark, _event_log(spark, m), "event_id long, user_id long").select("user_id"), "user_id")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("snapshot_equals_last", f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM {last('entity_versions', late('entity_versions'))} r")
def snapshot_equals_last(spark, m):
    """The state by aggregation against the state by replay of histories."""
    at = late_of(m["entity_versions"])
    one = asof.latest_at(m["entity_versions"], at).select("id", "version", "revision")
    two = asof.history(m["entity_versions"]).filter((F.col("revision") <= at) & (F.col("until").isNull() | (F.col("until") > at))).select("id", "version", "revision")
    both = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(-1))).groupBy("id", "version", "revision")
    return both.agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.abs("d")).cast("long").alias("differing"))
