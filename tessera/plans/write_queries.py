"""Queries over writes: lifecycle, deletion, closure, idempotency, import."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import asof, graph, ingest, writes
from tessera.plans.record_queries import last
from tessera.plans.registry import query

STATUS = "CASE s WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' WHEN 3 THEN 'disputed' WHEN 4 THEN 'superseded' WHEN 5 THEN 'retracted' ELSE 'expired' END"
OPERATIONS = ("accept", "reject", "dispute", "supersede", "retract", "expire")


@query("lifecycle_transition_matrix", f"""SELECT status, operation, CASE WHEN status = 'proposed' AND operation IN ('accept', 'reject') OR status = 'accepted' AND operation IN ('dispute', 'supersede', 'retract', 'expire') THEN 'ok' ELSE 'invalid_transition' END AS outcome,
    count(*) AS n FROM (SELECT {STATUS} AS status, CASE event_id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'dispute' WHEN 3 THEN 'supersede' WHEN 4 THEN 'retract' ELSE 'expire' END AS operation FROM (SELECT event_id, event_id % 7 AS s FROM {{events}})) GROUP BY ALL""")
def lifecycle_transition_matrix(spark, m):
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % by + 1).cast("int"))
    claims = m["events"].select(F.col("event_id").alias("id"), pick(writes.STATUSES, 7).alias("status"))
    operations = m["events"].select(F.col("event_id").alias("id"), pick(OPERATIONS, 6).alias("operation"))
    return writes.apply_transitions(claims, operations).groupBy("status", "operation", "outcome").agg(F.count("*").alias("n"))


@query("duplicate_mutations", "SELECT o_custkey AS txn, o_orderpriority AS id, count(*) AS n FROM {orders} GROUP BY ALL HAVING count(*) > 1")
def duplicate_mutations(spark, m):
    return writes.duplicate_mutations(m["orders"].select(F.col("o_custkey").alias("txn"), F.col("o_orderpriority").alias("id")))


@query("transaction_bounds", "SELECT l_suppkey AS txn, count(*) AS operations, CAST(sum(l_linenumber) AS BIGINT) AS refs, count(*) <= 600 AND sum(l_linenumber) <= 2400 AS ok FROM {lineitem} GROUP BY ALL")
def transaction_bounds(spark, m):
    return writes.transaction_bounds(m["lineitem"].select(F.col("l_suppkey").alias("txn"), F.col("l_linenumber").alias("refs")), 600, 2_400)


@query("closure_violations", """SELECT rel_id AS id, 'no_evidence' AS reason FROM {contains} WHERE supp % 11 = 0 UNION SELECT rel_id, 'missing_evidence' FROM {contains} WHERE supp % 11 = 1
    UNION SELECT rel_id, 'duplicate_evidence' FROM {contains} WHERE supp % 11 = 2 UNION SELECT rel_id, 'inactive_endpoint' FROM {contains} WHERE status <> 'retracted' AND CAST(split_part(dst, ':', 2) AS BIGINT) % 19 = 0""")
def closure_violations(spark, m):
    supplier = F.concat(F.lit("supplier:"), "supp")
    k = F.col("supp") % 11
    claims = m["contains"].select(F.col("rel_id").alias("id"), "status", F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("supplier:none"))).when(k == 2, F.array(supplier, supplier)).otherwise(F.array(supplier)).alias("evidence"), F.array("src", "dst").alias("ends"))
    entities = asof.latest_at(m["entity_versions"].filter("not startswith(id, 'user:')"))
    return writes.closure_violations(claims, None, entities, m["supplier"].select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id")))


@query("delete_dependents", """SELECT id, accepted, proposed, CASE WHEN accepted + proposed = 0 THEN 'deleted' WHEN proposed > 0 THEN 'cascade_refused' ELSE 'cascade_needed' END AS outcome FROM (
    SELECT 'part:' || CAST(p_partkey AS STRING) AS id, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'proposed') AS proposed FROM {part} LEFT JOIN {contains} ON dst = 'part:' || CAST(p_partkey AS STRING) GROUP BY p_partkey)""")
def delete_dependents(spark, m):
    return writes.delete_dependents(m["part"].select(F.concat(F.lit("part:"), "p_partkey").alias("id")), m["contains"])


@query("cascade_retract", "SELECT CASE WHEN status = 'accepted' AND CAST(split_part(dst, ':', 2) AS BIGINT) % 7 = 0 THEN 'retracted' ELSE status END AS status, count(*) AS n FROM {contains} GROUP BY ALL")
def cascade_retract(spark, m):
    return writes.cascade_retract(m["contains"], m["part"].filter("p_partkey % 7 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))).groupBy("status").agg(F.count("*").alias("n"))


@query("replace_entities", f"SELECT id, version + 1 AS version, CAST(99999999 AS BIGINT) AS revision, 'replaced' AS payload FROM {last('user_versions')} r WHERE lifecycle = 'active'")
def replace_entities(spark, m):
    users = m["user_versions"].select("id").distinct().withColumn("payload", F.lit("replaced"))
    return writes.replace_entities(m["user_versions"], users, 99_999_999).select("id", "version", "revision", "payload")


@query("correct_claims", "SELECT 'fix:' || rel_id AS id, rel_id AS correction_of, 'proposed' AS status FROM {contains} WHERE status = 'accepted' AND supp % 5 = 0")
def correct_claims(spark, m):
    fixes = m["contains"].filter("supp % 5 = 0").select(F.concat(F.lit("fix:"), "rel_id").alias("id"), F.col("rel_id").alias("correction_of"))
    return writes.correct_claims(m["contains"].withColumnRenamed("rel_id", "id"), fixes).select("id", "correction_of", "status")


@query("index_rebuild_check", "SELECT rel_id, node, neighbour, 'expected' AS side FROM (SELECT rel_id, src AS node, dst AS neighbour FROM {placed} WHERE CAST(split_part(src, ':', 2) AS BIGINT) % 100 = 3) x")
def index_rebuild_check(spark, m):
    right = graph.directed(m["placed"], "out")
    return writes.index_differences(right.filter(F.split_part("node", F.lit(":"), F.lit(2)).cast("long") % 100 != 3), right)


@query("idempotent_commit_outcomes", """SELECT principal, key, outcome, CASE WHEN outcome = 'replayed' THEN key * 10 END AS txn FROM (SELECT user_id % 10 AS principal, event_id AS key,
    CASE WHEN event_id % 4 = 0 THEN 'new' WHEN event_id % 9 = 0 THEN 'expired' WHEN event_id % 5 = 0 THEN 'conflict' ELSE 'replayed' END AS outcome FROM {events}) r""")
def idempotent_commit_outcomes(spark, m):
    k = F.col("event_id")
    base = m["events"].select((F.col("user_id") % 10).alias("principal"), k.alias("key"))
    requests = base.withColumn("digest", F.when(F.col("key") % 5 == 0, "other").otherwise("same")).withColumn("at", F.lit(100))
    committed = base.filter("key % 4 <> 0").withColumns({"digest": F.lit("same"), "txn": F.col("key") * 10, "expires": F.when(F.col("key") % 9 == 0, 99).otherwise(100)})
    return writes.idempotent_outcomes(requests, committed)


@query("commit_outcome_lookup", "SELECT event_id AS txn FROM {events} WHERE user_id = 7 AND event_type = 'click'")
def commit_outcome_lookup(spark, m):
    commits = m["events"].select(F.col("user_id").cast("string").alias("principal"), F.col("event_type").alias("key"), F.col("event_id").alias("txn"))
    return writes.commit_outcome(commits, "7", "click").select("txn")


@query("observation_dedup", """SELECT session, event, arg_min(id, revision) AS id, min(revision) AS revision, count(*) AS n, CASE WHEN count(DISTINCT payload) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'single' END AS outcome
    FROM (SELECT id, 'all' AS session, event, revision, payload FROM {observations}) o GROUP BY session, event""")
def observation_dedup(spark, m):
    return ingest.dedup_observations(m["observations"].withColumn("session", F.lit("all"))).drop("source")


@query("import_row_conflicts", """SELECT event AS source_event, 'duplicate_in_batch' AS reason FROM {observations} WHERE id >= 500 GROUP BY event HAVING count(*) > 1
    UNION ALL SELECT DISTINCT event, 'imported_before' FROM {observations} WHERE id >= 500 AND event IN (SELECT event + 100 FROM {observations} WHERE id < 500)""")
def import_row_conflicts(spark, m):
    rows = m["observations"].select("id", F.col("event").alias("source_event"))
    return ingest.row_conflicts(rows.filter("id >= 500"), rows.filter("id < 500").select((F.col("source_event") + 100).alias("source_event")))


@query("import_preview", """WITH b AS (SELECT event FROM {observations} WHERE id >= 500), d AS (SELECT event FROM b GROUP BY event HAVING count(*) > 1)
    SELECT event AS source_event, CAST(501 AS BIGINT) AS proposed_revision, CASE WHEN event IN (SELECT event FROM d) THEN 'duplicate_in_batch' WHEN event IN (SELECT event + 100 FROM {observations} WHERE id < 500) THEN 'imported_before' ELSE 'accepted' END AS outcome FROM b""")
def import_preview(spark, m):
    rows = m["observations"].select("id", F.col("event").alias("source_event"))
    return ingest.preview(rows.filter("id >= 500"), rows.filter("id < 500").select((F.col("source_event") + 100).alias("source_event")), 500)


@query("import_batch_outcomes", """SELECT job, sequence, CASE WHEN job >= 90 THEN 'job_not_found' WHEN job % 8 = 7 THEN 'job_completed' WHEN sequence % 11 = 5 THEN 'source_changed' WHEN sequence < job % 6 THEN 'batch_conflict' WHEN sequence > job % 6 OR job % 13 = 1 THEN 'invalid_checkpoint' ELSE 'accepted' END AS outcome
    FROM (SELECT event_id % 100 AS job, event_id // 100 AS sequence FROM {events}) b""")
def import_batch_outcomes(spark, m):
    return _batch_outcomes(spark, m["events"])


def _batch_outcomes(spark, events):
    job = F.col("job")
    jobs = spark.range(90).select(F.col("id").alias("job")).select("job", (job % 6).alias("next_batch"), F.lit("d").alias("source_digest"), F.lit("c").alias("cursor"), F.when(job % 8 == 7, "completed").otherwise("open").alias("status"))
    batches = events.select((F.col("event_id") % 100).alias("job"), F.floor(F.col("event_id") / 100).alias("sequence"))
    batches = batches.select("job", "sequence", F.when(F.col("sequence") % 11 == 5, "x").otherwise("d").alias("source_digest"), F.when(job % 13 == 1, "x").otherwise("c").alias("cursor"))
    return ingest.batch_outcomes(batches, jobs)


@query("job_read", "SELECT k AS job FROM range(0, 100) t(k) WHERE k % 17 <> 0 AND (k + 5) % 17 <> 0")
def job_read(spark, m):
    jobs = spark.range(100).select(F.col("id").alias("job"))
    bindings = jobs.select("job", F.explode(F.array("job", F.col("job") + 5)).alias("ref"))
    return ingest.readable_jobs(jobs, bindings, spark.range(0, 120, 17))


@query("job_start", "SELECT 'a' AS job, 'started' AS outcome UNION ALL SELECT 'b', 'job_exists'")
def job_start(spark, m):
    jobs = spark.createDataFrame([("b",)], "job string")
    entities = asof.latest_at(m["entity_versions"].filter("id = 'customer:1'"))
    return spark.createDataFrame([(j, ingest.start_job(jobs, j, entities, "customer:1")) for j in ("a", "b")], "job string, outcome string")
