"""Queries over versions: point and whole-state reads, history, valid time, authorization, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.values import byte_slice, canonical_map, is_identity, line_at, sha256_hex, status_at
from tessera.operators import asof, policy, replay
from tessera.plans.registry import query
from tessera.session import materialize, scratch
from tessera.sources import tables

LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS k FROM {view} WHERE revision <= {at}) t WHERE k = 1"


def last(view: str, at: str = "9000000000000") -> str:
    return "(" + LAST.replace("{view}", "{" + view + "}").replace("{at}", at) + ")"


def late(view: str, order: str = "revision") -> str:
    """SQL of a revision that most of a table's history takes part in; ``late_of`` has the same number."""
    return f"(SELECT max({order}) * 9 // 10 FROM {{{view}}})"


def late_of(rows, order="revision"):
    return asof.current_revision(rows, order) * 9 // 10


@query("record_at_current", f"SELECT id, version, revision, lifecycle, payload FROM {last('user_versions')} r")
def record_at_current(spark, m):
    return asof.latest_at(m["user_versions"]).select("id", "version", "revision", "lifecycle", "payload")


@query("record_at_revision", f"SELECT id, version, revision, lifecycle, payload FROM {last('user_versions', late('user_versions'))} r")
def record_at_revision(spark, m):
    return asof.latest_at(m["user_versions"], late_of(m["user_versions"])).select("id", "version", "revision", "lifecycle", "payload")


@query("record_point_get", f"SELECT id, version, revision FROM {last('user_versions', late('user_versions'))} r WHERE id = 'user:7'")
def record_point_get(spark, m):
    return asof.record_at(m["user_versions"], "user:7", late_of(m["user_versions"])).select("id", "version", "revision")


@query("full_record_scan", "SELECT id, count(*) AS versions FROM {entity_versions} GROUP BY id")
def full_record_scan(spark, m):
    return m["entity_versions"].groupBy("id").agg(F.count("*").alias("versions")).orderBy("id")


@query("history_of_record", "SELECT id, version, revision, lead(revision) OVER (PARTITION BY id ORDER BY revision) AS until FROM {user_versions}")
def history_of_record(spark, m):
    return asof.history(m["user_versions"]).select("id", "version", "revision", "until")


@query("snapshot_counts_by_kind", f"SELECT split_part(id, ':', 1) AS type, lifecycle, count(*) AS n FROM {last('entity_versions', late('entity_versions'))} r GROUP BY ALL")
def snapshot_counts_by_kind(spark, m):
    return asof.latest_at(m["entity_versions"], late_of(m["entity_versions"])).groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("type"), "lifecycle").agg(F.count("*").alias("n"))


@query("visible_records", f"SELECT id, version FROM {last('entity_versions')} r WHERE lifecycle = 'active'")
def visible_records(spark, m):
    return asof.visible(asof.latest_at(m["entity_versions"])).select("id", "version")


@query("prefix_scan", "SELECT id, version FROM {entity_versions} WHERE starts_with(id, 'user:1')")
def prefix_scan(spark, m):
    return tables.scan_prefix(m["entity_versions"], "id", "user:1").select("id", "version")


@query("predecessor_get", "SELECT event_id, event_type FROM {events} WHERE event_id <= 777 ORDER BY event_id DESC LIMIT 1")
def predecessor_get(spark, m):
    return tables.predecessor(m["events"], "event_id", 777).select("event_id", "event_type")


@query("reverse_cursor", "SELECT event_id, user_id FROM {events} ORDER BY event_id DESC LIMIT 50")
def reverse_cursor(spark, m):
    return m["events"].select("event_id", "user_id").orderBy(F.desc("event_id")).limit(50)


@query("sorted_run_range", "SELECT id, version, revision FROM {user_versions} WHERE id >= 'user:2' AND id < 'user:3'")
def sorted_run_range(spark, m):
    path = scratch(spark, "run")
    tables.write_sorted_run(m["user_versions"], path, "id", "revision", parts=4)
    return spark.read.parquet(path).filter("id >= 'user:2' and id < 'user:3'").select("id", "version", "revision")


@query("journal_range_scan", "SELECT id, revision FROM (SELECT event_id + 1 AS id, CAST(event_id // ((SELECT max(event_id) FROM {events}) // 16 + 1) AS BIGINT) + 1 AS revision FROM {events}) l WHERE revision BETWEEN 2 AND 15")
def journal_range_scan(spark, m):
    """All events in a log of 16 revisions; all but the first and the last are read."""
    log = tables.RevisionLog(spark, scratch(spark, "log"), "id long")
    size = asof.current_revision(m["events"], "event_id") // 16 + 1
    for r in range(1, 17):
        log.append(m["events"].filter(F.col("event_id").between((r - 1) * size, r * size - 1)).select((F.col("event_id") + 1).alias("id")), r)
    return log.read(2, 15, newest_first=True)


@query("snapshot_checkpoint", f"SELECT id, version FROM {last('user_versions', late('user_versions'))} r")
def snapshot_checkpoint(spark, m):
    path, at = scratch(spark, "snapshot"), late_of(m["user_versions"])
    digest = tables.write_snapshot(asof.latest_at(m["user_versions"], at), path, at)
    return tables.load_snapshot(spark, path, at, digest).select("id", "version")


@query("valid_at_instant", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE TIMESTAMP '1996-06-01' >= o_orderdate AND TIMESTAMP '1996-06-01' < o_orderdate + INTERVAL 90 DAY END AS holds FROM {orders}""")
def valid_at_instant(spark, m):
    kind = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("half_open")
    return m["orders"].select("o_orderkey", asof.valid_at(kind, F.col("o_orderdate"), F.expr("o_orderdate + interval 90 day"), F.expr("timestamp_ntz '1996-06-01 00:00:00'")).alias("holds"))


@query("unknown_valid_time_group", """SELECT coalesce(CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE TIMESTAMP '1996-06-01' >= o_orderdate END AS VARCHAR), 'unknown') AS holds, count(*) AS n FROM {orders} GROUP BY ALL""")
def unknown_valid_time_group(spark, m):
    kind = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("half_open")
    holds = asof.valid_at(kind, F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.expr("timestamp_ntz '1996-06-01 00:00:00'"))
    return m["orders"].groupBy(F.coalesce(holds.cast("string"), F.lit("unknown")).alias("holds")).agg(F.count("*").alias("n"))


@query("interval_validity", "SELECT l_orderkey, count(*) FILTER (WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY) AS valid, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY ALL")
def interval_validity(spark, m):
    rows = m["lineitem"].join(m["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    ok = asof.interval_ok(F.lit("half_open"), F.col("l_shipdate"), F.expr("o_orderdate + interval 30 day"))
    return rows.groupBy("l_orderkey").agg(F.count_if(ok).alias("valid"), F.count("*").alias("n"))


@query("bitemporal_at", """SELECT id, revision, CASE WHEN payload = 'view' THEN NULL ELSE 1000 >= revision AND (version % 2 = 0 OR 1000 < revision + 600) END AS holds FROM """ + last("user_versions", "900") + " r")
def bitemporal_at(spark, m):
    rows = m["user_versions"].select("id", "revision", F.when(F.col("payload") == "view", "unknown").otherwise("half_open").alias("valid_kind"), F.col("revision").alias("valid_start"), F.when(F.col("version") % 2 != 0, F.col("revision") + 600).alias("valid_end"))
    return asof.bitemporal(rows, 900, F.lit(1000)).select("id", "revision", "holds")


@query("contradictions", """SELECT src AS subject, CAST(l_linenumber AS BIGINT) AS line, count(DISTINCT dst) AS n FROM (SELECT 'order:' || CAST(l_orderkey AS STRING) AS src, l_linenumber, l_partkey AS dst FROM {lineitem} WHERE l_returnflag = 'N') GROUP BY ALL HAVING count(DISTINCT dst) > 1""")
def contradictions(spark, m):
    claims = m["lineitem"].select(F.concat(F.lit("order:"), "l_orderkey").alias("subject"), F.col("l_linenumber").cast("long").alias("predicate"), F.col("l_partkey").alias("object"), F.when(F.col("l_returnflag") == "N", "accepted").otherwise("other").alias("status"))
    return asof.contradictions(claims).select("subject", F.col("predicate").alias("line"), F.size("objects").cast("long").alias("n"))


@query("correction_chain", """WITH RECURSIVE c AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN event_id - 1 END AS up FROM {events}),
    w AS (SELECT id, up, id AS root, CAST(0 AS BIGINT) AS depth FROM c UNION ALL SELECT w.id, c.up, c.id, w.depth + 1 FROM w JOIN c ON w.up = c.id)
    SELECT id, root, depth FROM w WHERE up IS NULL""")
def correction_chain(spark, m):
    claims = m["events"].select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") - 1).alias("correction_of"))
    return asof.correction_chains(claims).filter("outcome = 'ok'").select("id", "root", "depth")


@query("precondition_outcomes", """WITH a AS (SELECT id, max(revision) AS r FROM {user_versions} GROUP BY id), n AS (SELECT max(revision) AS now FROM {user_versions}),
    c AS (SELECT 'user:' || CAST(k AS STRING) AS id, k, CASE WHEN k % 3 = 0 THEN 'absent' WHEN k % 3 = 1 THEN 'visible' ELSE 'version' END AS predicate, CAST(2 AS BIGINT) AS wanted, CASE WHEN k % 50 = 49 THEN 100000000 ELSE 300 + k END AS rev FROM range(0, 300) t(k)),
    s AS (SELECT c.*, (SELECT arg_max(lifecycle, revision) FROM {user_versions} u WHERE u.id = c.id AND u.revision <= c.rev) AS l1, (SELECT max(version) FROM {user_versions} u WHERE u.id = c.id AND u.revision <= c.rev) AS v1,
        (SELECT arg_max(lifecycle, revision) FROM {user_versions} u WHERE u.id = c.id) AS l2, (SELECT max(version) FROM {user_versions} u WHERE u.id = c.id) AS v2 FROM c),
    h AS (SELECT k, rev, CASE predicate WHEN 'absent' THEN v1 IS NULL WHEN 'visible' THEN coalesce(l1 = 'active', false) ELSE coalesce(v1 = wanted, false) END AS held_then,
        CASE predicate WHEN 'absent' THEN v2 IS NULL WHEN 'visible' THEN coalesce(l2 = 'active', false) ELSE coalesce(v2 = wanted, false) END AS holds_now FROM s)
    SELECT k AS check_id, held_then, holds_now, CASE WHEN rev > now THEN 'unknown_read_view' WHEN NOT held_then THEN 'predicate_failed' WHEN NOT holds_now THEN 'read_view_changed' ELSE 'ok' END AS outcome FROM h, n""")
def precondition_outcomes(spark, m):
    k = F.col("id")
    checks = spark.range(300).select(k.alias("check_id"), F.concat(F.lit("user:"), k).alias("id"), F.when(k % 3 == 0, "absent").when(k % 3 == 1, "visible").otherwise("version").alias("predicate"), F.lit(2).cast("long").alias("version"), F.when(k % 50 == 49, 100_000_000).otherwise(300 + k).alias("at"))
    return asof.read_view_outcomes(checks, m["user_versions"]).select("check_id", "held_then", "holds_now", "outcome")


@query("policy_visible_records", f"SELECT 'p' || CAST(p AS STRING) AS principal, count(*) AS n FROM {last('entity_versions')} r, range(0, 3) t(p) WHERE NOT (CAST(split_part(id, ':', 2) AS BIGINT) % 17 = p) GROUP BY ALL")
def policy_visible_records(spark, m):
    now = materialize(asof.latest_at(m["entity_versions"]).select("id", F.lit("main").alias("namespace")), "now")
    grants = spark.createDataFrame([(f"p{i}", "main", ["read", "expand"]) for i in range(3)] + [("p9", "main", ["commit"]), ("p8", "other", ["read"])], "principal string, namespace string, permissions array<string>")
    denies = now.select((F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 17).alias("k"), "id").filter("k < 3").select(F.concat(F.lit("p"), "k").alias("principal"), "id")
    return policy.allowed(now, grants, denies, "read").groupBy("principal").agg(F.count("*").alias("n"))


@query("ref_closure_visible", "SELECT rel_id FROM {placed} WHERE CAST(split_part(src, ':', 2) AS BIGINT) % 17 <> 0 AND CAST(split_part(dst, ':', 2) AS BIGINT) % 17 <> 0")
def ref_closure_visible(spark, m):
    placed = m["placed"].withColumnRenamed("rel_id", "id")
    refs = placed.select("id", F.explode(F.array("src", "dst")).alias("ref"))
    ends = refs.select(F.col("ref").alias("id")).distinct().filter(F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 17 != 0)
    return policy.closure_visible(placed, refs, ends.unionByName(placed.select("id"))).select(F.col("id").alias("rel_id"))


@query("quota_usage", "SELECT 'src' || CAST(g AS STRING) AS principal, CAST(coalesce(sum(length(e.payload)), 0) AS BIGINT) AS used, CAST(least(20000, 500 * (g + 1)) AS BIGINT) AS quota, coalesce(sum(length(e.payload)), 0) > least(20000, 500 * (g + 1)) AS exceeded FROM range(0, 30) t(g) LEFT JOIN (SELECT user_id % 25 AS u, event_type AS payload FROM {events}) e ON e.u = g GROUP BY g")
def quota_usage(spark, m):
    quotas = spark.range(30).select(F.concat(F.lit("src"), "id").alias("principal"), F.lit(20000).cast("long").alias("namespace_limit"), (500 * (F.col("id") + 1)).alias("grant_limit"))
    usage = m["events"].select(F.concat(F.lit("src"), F.col("user_id") % 25).alias("principal"), F.length("event_type").alias("bytes"))
    return policy.quota_usage(usage, quotas)


@query("replay_gap_check", "SELECT r AS revision FROM (SELECT revision AS r, lag(revision) OVER (ORDER BY revision) AS b FROM (SELECT DISTINCT event_id + 1 AS revision FROM {events} WHERE event_id % 97 <> 5)) WHERE b IS NOT NULL AND r <> b + 1")
def replay_gap_check(spark, m):
    return replay.revision_gaps(m["events"].filter("event_id % 97 <> 5").select((F.col("event_id") + 1).alias("revision")))


@query("snapshot_plus_suffix", f"SELECT id, version, revision FROM {last('user_versions')} r")
def snapshot_plus_suffix(spark, m):
    return replay.snapshot_plus_suffix(m["user_versions"], 600).select("id", "version", "revision")


@query("state_digest", "SELECT id, sha256(string_agg(row, chr(10) ORDER BY row)) AS digest FROM (SELECT id, CAST(version AS STRING) || '|' || lifecycle AS row FROM {user_versions}) GROUP BY id")
def state_digest(spark, m):
    return replay.state_digests(m["user_versions"].select("id", F.concat_ws("|", "version", "lifecycle").alias("row")), "id", "row")


@query("content_anchor_xor", "SELECT event_type, " + ", ".join(f"bit_xor(CAST('0x' || substr(sha256(row), {1 + 15 * i}, 15) AS BIGINT)) AS x{i}" for i in range(4)) + ", count(*) AS n FROM (SELECT event_type, CAST(event_id AS STRING) || ':' || CAST(user_id AS STRING) AS row FROM {events}) GROUP BY event_type")
def content_anchor_xor(spark, m):
    return replay.content_anchor(m["events"].select("event_type", F.concat_ws(":", "event_id", "user_id").alias("row")), ["event_type"], "row")


@query("hash_chain", """WITH RECURSIVE r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events}),
    w AS (SELECT user_id, k, sha256('|' || event_type) AS chain FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, sha256(w.chain || '|' || r.event_type) FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
    SELECT user_id, arg_max(chain, k) AS chain, max(k) AS n FROM w GROUP BY user_id""")
def hash_chain(spark, m):
    return replay.hash_chain(m["events"], "user_id", "event_id", "event_type")


@query("branch_overlay", f"SELECT id, CASE WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 5 = 1 THEN 'branch' ELSE payload END AS payload FROM {last('user_versions')} r WHERE CAST(split_part(id, ':', 2) AS BIGINT) % 5 <> 0")
def branch_overlay(spark, m):
    base = asof.latest_at(m["user_versions"]).select("id", "payload")
    k = F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 5
    return replay.branch_view(base, base.filter(k < 2).select("id", F.lit("branch").alias("payload"), (k == 0).alias("deleted")))


@query("promotion_conflicts", f"SELECT n.id FROM {last('user_versions')} n LEFT JOIN {last('user_versions', late('user_versions'))} t ON t.id = n.id WHERE n.version IS DISTINCT FROM t.version AND CAST(split_part(n.id, ':', 2) AS BIGINT) % 5 < 2")
def promotion_conflicts(spark, m):
    now = asof.latest_at(m["user_versions"])
    overlay = now.filter(F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 5 < 2)
    return replay.promotion_conflicts(asof.latest_at(m["user_versions"], late_of(m["user_versions"])), now, overlay).select("id")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM {events} GROUP BY event_type")
def latency_percentiles(spark, m):
    return replay.percentiles(m["events"], ["event_type"], "value").select("event_type", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 95, 99)], "n")


@query("corrected_time_summaries", "SELECT CAST(floor(seconds / 86400) AS BIGINT) AS day, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY revision DESC, id DESC) AS k FROM {observations}) o WHERE k = 1 GROUP BY ALL")
def corrected_time_summaries(spark, m):
    return replay.corrected_summaries(m["observations"].withColumn("day", F.floor(F.col("seconds") / 86400)), ["day"], "x")


@query("text_digests", "SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM {documents}")
def text_digests(spark, m):
    return m["documents"].select("doc_id", sha256_hex(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("line_locator", """SELECT conv_id, turn, outcome, CASE WHEN outcome = 'resolved' THEN 1 + len(list_filter(range(0, 60), lambda i: substr(h, 2 * i + 1, 2) = '0A')) END AS line FROM (
    SELECT conv_id, turn, h, CASE WHEN length(h) < 120 THEN 'out_of_range' WHEN substr(h, 121, 1) IN ('8', '9', 'A', 'B') THEN 'not_a_boundary' ELSE 'resolved' END AS outcome FROM (SELECT conv_id, turn, hex(encode(replace(text, ' ', chr(10)))) AS h FROM {conversations}) b) c""")
def line_locator(spark, m):
    """The line of byte 60 of every turn; as in the reference, an offset beyond the text or inside a character has none."""
    t = F.translate("text", " ", "\n")
    before = byte_slice(t, F.lit(0), F.lit(60))
    outcome = F.when(F.octet_length(t) < 60, "out_of_range").when(before.isNull(), "not_a_boundary").otherwise("resolved")
    return m["conversations"].select("conv_id", "turn", outcome.alias("outcome"), F.when(outcome == "resolved", line_at(t, F.lit(60))).cast("long").alias("line"))


@query("claim_status_at", "SELECT id, CASE WHEN terminal_revision <= 500 THEN 'ended' ELSE 'active' END AS status FROM {facts}")
def claim_status_at(spark, m):
    return m["facts"].select("id", status_at(F.lit("ended"), F.col("terminal_revision"), 500).alias("status"))


@query("identity_check", "SELECT event_id, event_id % 3 = 0 AS ok FROM {events}")
def identity_check(spark, m):
    h = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 32)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("db_"), h)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("ns_"), h)).otherwise(F.concat(F.lit("db_"), h, F.lit("0")))
    return m["events"].select("event_id", is_identity(text, "db").alias("ok"))


@query("map_field_selection", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}")
def map_field_selection(spark, m):
    return m["events"].select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("canonical_value", """SELECT event_id, '{{"event":"' || event_type || '","user":"' || CAST(user_id AS STRING) || '"}}' AS canonical FROM {events}""")
def canonical_value(spark, m):
    return m["events"].select("event_id", canonical_map(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))).alias("canonical"))
