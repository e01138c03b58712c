"""The driver's tables as tables of the model: one statement each, the same for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "user_versions": """SELECT 'user:' || CAST(user_id AS STRING) AS id, 'entity' AS kind,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version, event_id + 1 AS revision,
        CASE WHEN event_id % 7 = 6 THEN 'deleted' ELSE 'active' END AS lifecycle, event_type AS payload FROM {events}""",
    "entity_versions": """SELECT id, kind, version, revision, lifecycle, payload FROM {user_versions}
        UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 'entity', CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'active', c_mktsegment FROM {customer}
        UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), 'entity', CAST(1 AS BIGINT), CAST(1 AS BIGINT), CASE WHEN p_partkey % 19 = 0 THEN 'deleted' ELSE 'active' END, p_brand FROM {part}
        UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'entity', CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'active', 'supplier' FROM {supplier}
        UNION ALL SELECT 'order:' || CAST(o_orderkey AS STRING), 'entity', CAST(1 AS BIGINT), o_orderkey + 1, 'active', o_orderpriority FROM {orders}""",
    "contains": """SELECT 'c' || CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
        CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS STRING) AS rel_id,
        'order:' || CAST(l_orderkey AS STRING) AS src, 'part:' || CAST(l_partkey AS STRING) AS dst,
        CASE WHEN l_returnflag = 'N' THEN 'accepted' WHEN l_returnflag = 'A' THEN 'proposed' ELSE 'retracted' END AS status, l_orderkey + 1 AS revision, l_suppkey AS supp FROM {lineitem}""",
    "placed": """SELECT 'p' || CAST(o_orderkey AS STRING) AS rel_id, 'customer:' || CAST(o_custkey AS STRING) AS src, 'order:' || CAST(o_orderkey AS STRING) AS dst,
        'accepted' AS status, o_orderkey + 1 AS revision FROM {orders}""",
    "supplied": """SELECT DISTINCT 's' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey AS STRING) AS rel_id, 'supplier:' || CAST(l_suppkey AS STRING) AS src,
        'part:' || CAST(l_partkey AS STRING) AS dst, 'accepted' AS status FROM {lineitem}""",
    "edges": """SELECT rel_id, src, dst, status FROM {contains} UNION ALL SELECT rel_id, src, dst, status FROM {placed}""",
    "observations": """SELECT event_id AS id, 'user:' || CAST(user_id AS STRING) AS entity, event_type AS session,
        CASE WHEN event_id % 100 = 2 THEN event_id - 1 ELSE event_id END AS event,
        CASE WHEN event_id % 20 = 0 THEN event_id + 51 ELSE event_id + 1 END AS revision,
        event_id * 60 AS seconds, (event_id * 7919) % 1000003 AS x, (user_id * 104729 + event_id) % 1000033 AS y,
        CASE WHEN event_id % 211 = 0 THEN 'depot' ELSE 'world' END AS frame,
        CASE WHEN event_id % 200 = 102 THEN 'other' ELSE 'same' END AS payload, 'feed' AS source FROM {events}""",
    "points": """SELECT event_id AS id, (event_id * 7368787 * 1009 + user_id) % 360000000001 - 180000000000 AS lon,
        (event_id * 15485863 * 13) % 180000000001 - 90000000000 AS lat FROM {events}""",
    "sources": """SELECT source, version, recorded, lead(recorded) OVER (PARTITION BY source ORDER BY version) AS superseded, revoked, text, sha256_text AS digest FROM (
        SELECT 'src' || CAST(doc_id % 200 AS STRING) AS source, CAST(row_number() OVER (PARTITION BY doc_id % 200 ORDER BY doc_id) AS BIGINT) AS version, doc_id + 1 AS recorded,
        CASE WHEN doc_id % 29 = 0 THEN doc_id + 40 END AS revoked, text, doc_id AS sha256_text FROM {documents}) d""",
    "facts": """SELECT 'q' || CAST(l.doc_id AS STRING) AS id, 'doc:' || CAST(l.doc_id AS STRING) AS subject, 'quality' AS predicate, CAST(l.quality AS STRING) AS value,
        'src' || CAST(l.doc_id % 200 AS STRING) AS source, CAST(floor(l.doc_id / 200) AS BIGINT) + 1 AS version, l.doc_id + 1 AS recorded,
        CASE WHEN l.doc_id % 13 = 0 THEN l.doc_id + 100 END AS terminal_revision, CASE WHEN l.doc_id % 3 = 0 THEN CAST(l.doc_id AS BIGINT) * 1000 END AS event_time, l.doc_id AS doc_id, l.toxic AS toxic FROM {labels} l""",
}


def oracle_text(sql: str) -> str:
    """``sql`` with the views it names in braces put before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if "{" + name + "}" in text and name not in wanted:
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    plain = {t: t for t in TABLES} | {v: v for v in VIEWS}
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**plain)})" for v in wanted)
    text = sql.format(**plain).strip()
    if not views:
        return text
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return f"{head}{views}, {text[len(head):]}"
    return f"WITH {views} {text}"


def _supplied(m: Model) -> DataFrame:
    """Distinct by the numbers, which are shorter than the texts made of them."""
    pairs = m["lineitem"].select("l_suppkey", "l_partkey").distinct()
    s, p = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    return pairs.select(F.concat(F.lit("s"), s, F.lit("-"), p).alias("rel_id"), F.concat(F.lit("supplier:"), s).alias("src"), F.concat(F.lit("part:"), p).alias("dst"), F.lit("accepted").alias("status"))


def _contains(m: Model) -> DataFrame:
    """Numbers only the lines whose key another line may share; most keys are unique, and only their hashes are shuffled.

    Up to ``MAX_REPEATED`` hashes that repeat are broadcast; beyond that all lines are numbered in one window.
    """
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = m["lineitem"].select(*key, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    hashed = lines.withColumn("_h", F.xxhash64(*key))
    repeated = materialize(hashed.groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").select("_h"), "repeated")
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    if repeated.limit(MAX_REPEATED + 1).count() <= MAX_REPEATED:
        several = hashed.join(F.broadcast(repeated), "_h", "left_semi").withColumn("turn", turn)
        numbered = hashed.join(F.broadcast(repeated), "_h", "left_anti").withColumn("turn", F.lit(1)).unionByName(several)
    else:
        numbered = lines.withColumn("turn", turn)
    text = lambda c: F.col(c).cast("string")
    flag = F.when(F.col("l_returnflag") == "N", "accepted").when(F.col("l_returnflag") == "A", "proposed").otherwise("retracted")
    dash = F.lit("-")
    return numbered.select(
        F.concat(F.lit("c"), text("l_orderkey"), dash, text("l_partkey"), dash, text("l_suppkey"), dash, text("l_linenumber"), dash, text("turn")).alias("rel_id"),
        F.concat(F.lit("order:"), text("l_orderkey")).alias("src"), F.concat(F.lit("part:"), text("l_partkey")).alias("dst"),
        flag.alias("status"), (F.col("l_orderkey") + 1).alias("revision"), F.col("l_suppkey").alias("supp"),
    )


MAX_REPEATED = 1_000_000

# the same rows as the statements above give, by plans that shuffle less
PLANS = {"contains": _contains, "supplied": _supplied}


class Model:
    """The model's tables over a directory; only what a query names is read."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self._held = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in TABLES:
                self._held[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in PLANS:
                self._held[name] = PLANS[name](self)
            else:
                used = {n: self[n] for n in [*TABLES, *VIEWS] if "{" + n + "}" in VIEWS[name]}
                self._held[name] = self.spark.sql(VIEWS[name], **used)
        return self._held[name]
