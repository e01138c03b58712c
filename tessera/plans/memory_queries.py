"""Queries over source-cited facts, search with budgets, and content adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.values import ascii_lower, fact_bytes, freshness
from tessera.operators import asof, ingest, memory, search
from tessera.plans.record_queries import late, late_of
from tessera.plans.registry import query

ELIGIBLE = """SELECT f.id FROM {facts} f JOIN {sources} s ON s.source = f.source AND s.version = f.version WHERE f.recorded <= 700 AND (f.terminal_revision IS NULL OR f.terminal_revision > 700)
    AND s.recorded <= 700 AND s.revoked IS NULL AND (s.superseded IS NULL OR s.superseded > 700)"""
ELIGIBLE_LATE = ELIGIBLE.replace("700", late("facts", "recorded"))
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _facts(m):
    links = F.array(F.concat(F.lit("q"), F.col("doc_id") - 1), F.concat(F.lit("q"), F.col("doc_id") + 3))
    return m["facts"].withColumn("links", links)


def _claims(m):
    return m["facts"].join(m["documents"].select("doc_id", F.col("text").alias("excerpts")), "doc_id").withColumn("status_revision", F.col("terminal_revision"))


def _cites(m):
    start = 10 + F.col("doc_id") % 50
    return m["facts"].select("id", "source", "version", start.cast("int").alias("start"), (start + 20).cast("int").alias("end"))


@query("fact_eligibility_at", ELIGIBLE_LATE)
def fact_eligibility_at(spark, m):
    return memory.eligible_facts(m["facts"], m["sources"], late_of(m["facts"], "recorded")).select("id")


@query("fact_eligibility_denied", ELIGIBLE_LATE + " AND f.doc_id % 17 <> 0 AND (f.doc_id - 1) % 17 <> 0 AND (f.doc_id + 3) % 17 <> 0")
def fact_eligibility_denied(spark, m):
    last_doc = asof.current_revision(m["facts"], "doc_id")
    denied = spark.range(-17, last_doc + 4, 17).select(F.concat(F.lit("q"), "id").alias("id"))
    return memory.eligible_facts(_facts(m), m["sources"], late_of(m["facts"], "recorded"), denied).select("id")


@query("get_fact", ELIGIBLE_LATE.replace("SELECT f.id", "SELECT f.id, f.subject, f.value, 192 + CAST(strlen(f.subject) + 7 + strlen(f.value) AS BIGINT) + 32 AS bytes"))
def get_fact(spark, m):
    rows = memory.eligible_facts(_facts(m), m["sources"], late_of(m["facts"], "recorded"))
    return rows.select("id", "subject", "value", fact_bytes(F.col("subject"), F.col("predicate"), F.col("value"), F.size("links")).cast("long").alias("bytes"))


@query("one_hop_links", f"WITH e AS ({ELIGIBLE_LATE}) SELECT id, position, linked FROM (SELECT id, CAST(p AS BIGINT) AS position, 'q' || CAST(CASE p WHEN 0 THEN doc_id - 1 ELSE doc_id + 3 END AS STRING) AS linked FROM {{facts}}, range(0, 2) t(p)) l WHERE linked IN (SELECT id FROM e)")
def one_hop_links(spark, m):
    return memory.fact_links(_facts(m), memory.eligible_facts(m["facts"], m["sources"], late_of(m["facts"], "recorded"))).select("id", F.col("position").cast("long").alias("position"), "linked")


@query("source_versions_at", "SELECT source, version, recorded, CASE WHEN superseded <= 500 THEN superseded END AS superseded, revoked FROM {sources} WHERE recorded <= 500")
def source_versions_at(spark, m):
    return memory.source_versions_at(m["sources"], 500)


@query("source_version_confirm", "SELECT source, version, recorded FROM {sources} WHERE source = 'src5' AND version = 2")
def source_version_confirm(spark, m):
    return m["sources"].filter("source = 'src5' and version = 2").select("source", "version", "recorded")


@query("research_edges_from", "SELECT 'e' || CAST(event_id AS STRING) AS id, 'r' || CAST(user_id AS STRING) AS \"from\", 'r' || CAST((user_id * 3 + event_id) % 500 AS STRING) AS \"to\" FROM {events} WHERE event_type = 'click' AND (user_id * 3 + event_id) % 500 % 17 <> 0 AND event_id % 23 <> 0")
def research_edges_from(spark, m):
    edges = m["events"].select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("r"), "user_id").alias("from"), F.concat(F.lit("r"), (F.col("user_id") * 3 + F.col("event_id")) % 500).alias("to"), F.lit("a0").alias("asserted_by"))
    denied = spark.range(0, 500, 17).select(F.concat(F.lit("r"), "id").alias("id")).unionByName(m["events"].filter("event_id % 23 = 0").select(F.concat(F.lit("e"), "event_id").alias("id")))
    return memory.edges_from(edges, denied, "click").select("id", "from", "to")


@query("research_edges_limited", f"""WITH e AS (SELECT 'e' || CAST(event_id AS STRING) AS id, 'r' || CAST(user_id AS STRING) AS "from", (user_id * 3 + event_id) % 500 AS t, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY 'e' || CAST(event_id AS STRING)) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {{events}} WHERE event_id <= (SELECT max(event_id) * 9 // 10 FROM {{events}})),
    g AS (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY id) AS j, count(*) OVER (PARTITION BY "from") AS m FROM e WHERE k <= 40 AND event_type = 'click' AND t % 17 <> 0 AND event_id % 23 <> 0)
    SELECT id, "from", 'r' || CAST(t AS STRING) AS "to", n > 40 OR m > 5 AS truncated FROM g WHERE j <= 5""")
def research_edges_limited(spark, m):
    e = m["events"]
    edges = e.select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("r"), "user_id").alias("from"), F.concat(F.lit("r"), (F.col("user_id") * 3 + F.col("event_id")) % 500).alias("to"), F.lit("a0").alias("asserted_by"), F.col("event_id").alias("recorded"))
    denied = spark.range(0, 500, 17).select(F.concat(F.lit("r"), "id").alias("id")).unionByName(e.filter("event_id % 23 = 0").select(F.concat(F.lit("e"), "event_id").alias("id")))
    return memory.edges_from(edges, denied, "click", late_of(e, "event_id"), 40, 5).select("id", "from", "to", "truncated")


@query("citation_excerpt", """SELECT id, outcome, CASE WHEN outcome = 'resolved' THEN decode(unhex(excerpt)) END AS excerpt, CASE WHEN outcome = 'resolved' THEN sha256(unhex(excerpt)) END AS excerpt_sha256, CASE WHEN outcome = 'resolved' THEN CAST(20 + 160 AS BIGINT) END AS bytes FROM (
    SELECT id, CASE WHEN revoked IS NOT NULL THEN 'withheld' WHEN length(h) < 2 * (start + 20) THEN 'out_of_range' WHEN substr(h, 2 * start + 1, 1) IN ('8', '9', 'A', 'B') OR substr(h, 2 * start + 41, 1) IN ('8', '9', 'A', 'B') THEN 'not_a_boundary' ELSE 'resolved' END AS outcome, substr(h, 2 * start + 1, 40) AS excerpt
    FROM (SELECT f.id, s.revoked, hex(encode(s.text)) AS h, 10 + CAST(f.doc_id % 50 AS BIGINT) AS start FROM {facts} f JOIN {sources} s ON s.source = f.source AND s.version = f.version) b) c""")
def citation_excerpt(spark, m):
    return memory.resolve_citations(_cites(m), m["sources"]).select("id", "outcome", "excerpt", "excerpt_sha256", "bytes")


@query("citation_multibyte", """SELECT id, outcome, CASE WHEN outcome = 'resolved' THEN CAST(length(decode(unhex(substr(h, 1, 80)))) AS BIGINT) END AS chars, CASE WHEN outcome = 'resolved' THEN CAST(40 + 160 AS BIGINT) END AS bytes FROM (
    SELECT f.id, hex(encode(s.text)) AS h, CASE WHEN s.revoked IS NOT NULL THEN 'withheld' WHEN octet_length(encode(s.text)) < 40 THEN 'out_of_range' WHEN substr(hex(encode(s.text)), 81, 1) IN ('8', '9', 'A', 'B') THEN 'not_a_boundary' ELSE 'resolved' END AS outcome
    FROM {facts} f JOIN {sources} s ON s.source = f.source AND s.version = f.version) b""")
def citation_multibyte(spark, m):
    cites = m["facts"].select("id", "source", "version", F.lit(0).alias("start"), F.lit(40).alias("end"))
    return memory.resolve_citations(cites, m["sources"]).select("id", "outcome", F.length("excerpt").cast("long").alias("chars"), "bytes")


@query("claim_effective_support", """WITH c AS (SELECT f.id, f.value AS support, s.revoked FROM {facts} f LEFT JOIN {sources} s ON s.source = f.source AND (s.version = f.version OR s.version = f.version + 1) AND s.source NOT IN ('src0', 'src17'))
    SELECT id, CASE WHEN support = '0' THEN 'recorded_unsupported' WHEN NOT seen THEN 'no_visible_citation' WHEN gone THEN 'revoked@' || CAST(r AS STRING) ELSE 'as_recorded' END AS effective FROM (
    SELECT id, any_value(support) AS support, bool_or(hit) AS seen, bool_and(revoked IS NOT NULL) AS gone, max(revoked) AS r FROM (SELECT f.id, f.value AS support, s.revoked, s.source IS NOT NULL AS hit FROM {facts} f LEFT JOIN {sources} s ON s.source = f.source AND (s.version = f.version OR s.version = f.version + 1) AND s.source NOT IN ('src0', 'src17')) GROUP BY id)""")
def claim_effective_support(spark, m):
    claims = m["facts"].select("id", F.when(F.col("value") == "0", "unsupported").otherwise("supported").alias("support"))
    cites = m["facts"].select("id", "source", F.explode(F.array("version", F.col("version") + 1)).alias("version"))
    return memory.claim_support(claims, cites, m["sources"], spark.createDataFrame([("src0",), ("src17",)], "id string"))


@query("freshness_states", "SELECT doc_id, CASE WHEN 500000 < doc_id * 1000 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'fresh' WHEN 500000 - doc_id * 1000 > 200000 THEN 'stale:' || CAST(500000 - doc_id * 1000 AS STRING) ELSE 'fresh' END AS state FROM {documents}")
def freshness_states(spark, m):
    kind = F.when(F.col("doc_id") % 5 == 0, "pinned").otherwise("max_age")
    return m["documents"].select("doc_id", freshness(kind, F.col("doc_id") * 1000, F.lit(500_000), F.lit(200_000)).alias("state"))


@query("fold_facts", """WITH p AS (SELECT event_id AS id, event_id + 1 AS recorded, CASE WHEN event_id % 10 = 4 THEN event_id - 3 END AS corrects FROM {events} WHERE event_id % 10 <> 7),
    e AS (SELECT corrects AS id, recorded AS revision, 'superseded' AS terminal FROM p WHERE corrects IS NOT NULL UNION ALL SELECT event_id - 6, event_id + 1, 'retracted' FROM {events} WHERE event_id % 10 = 7)
    SELECT id, recorded, corrects, revision AS terminal_revision, terminal FROM p LEFT JOIN (SELECT id, min(revision) AS revision, arg_min(terminal, revision) AS terminal FROM e GROUP BY id) USING (id)""")
def fold_facts(spark, m):
    k = F.col("event_id")
    mutations = m["events"].select(F.when(k % 10 == 7, k - 6).otherwise(k).alias("id"), (k + 1).alias("revision"), F.when(k % 10 == 7, "retract").when(k % 10 == 4, "correct").otherwise("put").alias("op"), F.when(k % 10 == 4, k - 3).alias("corrects"))
    return memory.fold_facts(mutations).select("id", "recorded", "corrects", "terminal_revision", "terminal")


@query("fold_sources", "SELECT source, version, recorded, superseded, true AS contiguous FROM {sources}")
def fold_sources(spark, m):
    return memory.fold_sources(m["sources"].select("source", "version", F.col("recorded").alias("revision")))


@query("pilot_links_to_edges", "SELECT left(sha256('related|' || id || '|' || linked), 32) AS id, 'related' AS kind, id AS \"from\", linked AS \"to\" FROM (SELECT id, 'q' || CAST(CASE p WHEN 0 THEN doc_id - 1 ELSE doc_id + 3 END AS STRING) AS linked FROM {facts}, range(0, 2) t(p)) l")
def pilot_links_to_edges(spark, m):
    return memory.map_pilot_links(_facts(m))


@query("lexical_search_and", f"SELECT f.id FROM {{facts}} f JOIN {{documents}} d ON d.doc_id = f.doc_id WHERE contains({FOLD.format('d.text')}, 'the') AND contains({FOLD.format('d.text')}, 'ing')")
def lexical_search_and(spark, m):
    facts = m["facts"].join(m["documents"].select("doc_id", F.col("text").alias("source_text")), "doc_id")
    return search.search_facts(facts, ["THE", "ing"], max_candidates=10_000_000).select("id")


@query("claim_search", f"SELECT f.id, false AS truncated FROM {{facts}} f JOIN {{documents}} d ON d.doc_id = f.doc_id WHERE (f.terminal_revision IS NULL OR f.terminal_revision > 300) AND contains({FOLD.format('d.text')}, 'the')")
def claim_search(spark, m):
    return search.search_claims(_claims(m), ["the"], 300, None).select("id", "truncated")


@query("search_truncated_bytes", """WITH r AS (SELECT user_id, event_id, row_number() OVER w AS k, sum(100 + event_id % 300) OVER w AS s FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    c AS (SELECT *, max(CASE WHEN k > 12 OR s > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS cut FROM r)
    SELECT user_id, event_id, t AS truncated FROM (SELECT *, max(cut) OVER (PARTITION BY user_id) = 1 AS t FROM c) WHERE cut = 0""")
def search_truncated_bytes(spark, m):
    rows = m["events"].select("user_id", "event_id", (100 + F.col("event_id") % 300).alias("bytes"))
    return search.within_budget(rows, 12, 1_500, ["user_id"], "event_id").select("user_id", "event_id", "truncated")


@query("event_time_filters", "SELECT 'any' AS mode, count(*) AS n FROM {facts} UNION ALL SELECT 'exact', count(*) FROM {facts} WHERE event_time = 300000 UNION ALL SELECT 'missing', count(*) FROM {facts} WHERE event_time IS NULL")
def event_time_filters(spark, m):
    one = lambda mode: F.count_if(search.time_filter(F.col("event_time"), mode, F.lit(300_000)))
    modes = F.array(*[F.struct(F.lit(k).alias("mode"), one(k).alias("n")) for k in ("any", "exact", "missing")])
    return m["facts"].agg(modes.alias("m")).select(F.inline("m"))


@query("claim_byte_accounting", "SELECT conv_id, CAST(128 + sum(64 + octet_length(encode(text))) AS BIGINT) AS bytes FROM {conversations} GROUP BY conv_id")
def claim_byte_accounting(spark, m):
    return memory.byte_accounts(m["conversations"].select("conv_id", F.col("text").alias("excerpt")), "conv_id")


@query("edge_kind_filter", "SELECT event_type AS kind, count(*) AS n FROM {events} WHERE event_type = 'view' GROUP BY event_type")
def edge_kind_filter(spark, m):
    return m["events"].filter("event_type = 'view'").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("bm25_search", f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({FOLD.format('text')}, '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {{documents}}),
    t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'de')) AS b FROM w),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
    SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM t, s WHERE a > 0 OR b > 0""")
def bm25_search(spark, m):
    return search.bm25(m["documents"], ["the", "de"]).select("doc_id", F.round("score", 6).alias("score"))


@query("vector_topk", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q, q)), 6) AS cosine FROM {embeddings}, (SELECT list(1.0 / (i + 1) ORDER BY i) AS q FROM (SELECT CAST(i AS DOUBLE) AS i FROM range(0, 64) t(i))) ORDER BY 2 DESC, 1 LIMIT 20")
def vector_topk(spark, m):
    return search.vector_topk(m["embeddings"], [1.0 / (i + 1) for i in range(64)], 20).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("keyset_page", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 25")
def keyset_page(spark, m):
    return search.page_after(m["customer"], 100, 25, "c_custkey").select("c_custkey", "c_name")


@query("json_adapter", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 10 = 0 THEN 'malformed' WHEN event_id % 10 = 1 OR json_extract(props, '$.k') IS NULL THEN 'partial' ELSE 'complete' END AS outcome FROM {events}")
def json_adapter(spark, m):
    k = F.col("event_id") % 10
    rows = m["events"].select("event_id", F.when(k == 0, F.lit('{"k": ')).when(k == 1, F.lit("{}")).otherwise(F.col("props")).alias("raw"))
    return ingest.json_rows(rows, "raw", "k long").select("event_id", "k", "outcome")


@query("csv_adapter", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 9 = 0 THEN 'malformed' ELSE 'complete' END AS outcome FROM {events}")
def csv_adapter(spark, m):
    raw = F.concat_ws(",", F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.col("user_id").cast("string")), "event_type")
    return ingest.csv_rows(m["events"].select("event_id", raw.alias("raw")), "raw", "user_id long, kind string").select("event_id", "user_id", "outcome")


@query("html_text_extract", None)
def html_text_extract(spark, m):
    return ingest.html_text(m["pages"])


@query("ascii_fold", "SELECT doc_id, sha256(" + FOLD.format("text") + ") AS folded FROM {documents}")
def ascii_fold(spark, m):
    return m["documents"].select("doc_id", F.sha2(F.encode(ascii_lower(F.col("text")), "UTF-8"), 256).alias("folded"))
