"""Queries over time and space: strict instants, places, estimates, motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo, timex
from tessera.operators import space
from tessera.plans.registry import query
from tessera.sources import tables

HAVERSINE = "2 * 6371007.1809 * atan2(sqrt(h), sqrt(1 - h)) FROM (SELECT id, lon, lat, pow(sin((radians(lat / 1e9) - radians(48.1)) / 2), 2) + cos(radians(48.1)) * cos(radians(lat / 1e9)) * pow(sin((radians(lon / 1e9) - radians(11.5)) / 2), 2) AS h FROM {points})"

TIMES = [
    ("1969-12-31T23:59:59.5Z", "resolved", None, -1, 500_000_000), ("2024-02-29T12:00:00+02:00", "resolved", None, 1709200800, 0),
    ("2023-02-29T12:00:00Z", "invalid", "malformed", None, None), ("2016-12-31T23:59:60Z", "unsupported", "leap_second", None, None),
    ("2024-01-01T00:00:00-00:00", "ambiguous", "unknown_offset", None, None), ("0001-01-01T00:00:00Z", "resolved", None, -62135596800, 0),
    ("2024-01-01 00:00:00Z", "invalid", "malformed", None, None), ("2024-01-01T24:00:00Z", "invalid", "malformed", None, None),
    ("2024-01-01T00:00:00.1234567891Z", "invalid", "malformed", None, None), ("9999-12-31T23:59:59.999999999Z", "resolved", None, 253402300799, 999_999_999), (None, "missing", None, None, None),
]
LOCAL = [
    ("2024-03-10 02:30:00", None, "invalid", "nonexistent_local_time", None), ("2024-11-03 01:30:00", None, "ambiguous", "fold", None),
    ("2024-11-03 01:30:00", "earlier", "resolved", None, 1730615400000000), ("2024-11-03 01:30:00", "later", "resolved", None, 1730619000000000),
    ("2024-07-01 12:00:00", None, "resolved", None, 1719853200000000), ("2024-07-01 12:00:00", "earlier", "invalid", "needless_fold", None),
]


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"


def _values(rows, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({columns})"


@query("rfc3339_normalize", "SELECT text, outcome, reason, CAST(s AS BIGINT) AS s, CAST(n AS INTEGER) AS n FROM (" + _values(TIMES, "text, outcome, reason, s, n") + ")")
def rfc3339_normalize(spark, m):
    rows = spark.createDataFrame([(t[0],) for t in TIMES], "text string")
    return rows.select("text", timex.parse_rfc3339(F.col("text")).alias("p")).select("text", "p.*")


@query("rfc3339_of_table", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM {events}")
def rfc3339_of_table(spark, m):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return m["events"].select("event_id", timex.parse_rfc3339(text)["s"].alias("s"))


@query("epoch_normalize", "SELECT event_id, CAST(floor((event_id * 977 - 5000000) / 1000.0) AS BIGINT) AS s, CAST((((event_id * 977 - 5000000) % 1000) + 1000) % 1000 * 1000000 AS INTEGER) AS n FROM {events}")
def epoch_normalize(spark, m):
    return m["events"].select("event_id", timex.epoch(F.col("event_id") * 977 - 5_000_000, "ms").alias("i")).select("event_id", "i.s", "i.n")


@query("local_zone_resolution", "SELECT local, CAST(choose AS VARCHAR) AS choose, outcome, reason, CAST(utc AS BIGINT) AS utc FROM (" + _values(LOCAL, "local, choose, outcome, reason, utc") + ")")
def local_zone_resolution(spark, m):
    out = None
    for local, choose, *_ in LOCAL:
        row = spark.createDataFrame([(local, choose)], "local string, choose string")
        row = row.select("local", "choose", timex.resolve_local(F.col("local").cast("timestamp_ntz"), "America/Chicago", choose).alias("r")).select("local", "choose", "r.outcome", "r.reason", F.col("r.utc_micros").alias("utc"))
        out = row if out is None else out.unionByName(row)
    return out


@query("date_only", "SELECT text, outcome, reason FROM (" + _values([("2024-02-29", "ambiguous", "date_only_without_policy"), ("2023-02-29", "invalid", None), (None, "missing", None), ("2024-2-9", "invalid", None)], "text, outcome, reason") + ")")
def date_only(spark, m):
    rows = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), (None,), ("2024-2-9",)], "text string")
    return rows.select("text", timex.date_only(F.col("text")).alias("p")).select("text", "p.outcome", "p.reason")


@query("format_utc", "SELECT event_id, strftime(to_timestamp(event_id * 86399) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.5' ELSE '.000000007' END || 'Z' AS text FROM {events}")
def format_utc(spark, m):
    k = F.col("event_id") % 3
    nanos = F.when(k == 0, 0).when(k == 1, 500_000_000).otherwise(7)
    return m["events"].select("event_id", timex.format_utc(F.col("event_id") * 86399, nanos).alias("text"))


@query("present_in_zone", "SELECT event_id, strftime(to_timestamp(event_id * 86399) AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%dT%H:%M:%S') || '+05:30[Asia/Kolkata]' AS text FROM {events}")
def present_in_zone(spark, m):
    return m["events"].select("event_id", timex.present_in_zone(F.col("event_id") * 86399, "Asia/Kolkata").alias("text"))


@query("canonical_points", "SELECT id, CASE WHEN abs(lat) = 90000000000 THEN 0 WHEN lon = 180000000000 THEN -180000000000 ELSE lon END AS lon, lat FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 180000000000 ELSE lon END AS lon, CASE WHEN id % 15 = 0 THEN -90000000000 ELSE lat END AS lat FROM {points}) p")
def canonical_points(spark, m):
    rows = m["points"].select("id", F.when(F.col("id") % 10 == 0, 180 * geo.DEGREE).otherwise(F.col("lon")).alias("lon"), F.when(F.col("id") % 15 == 0, -90 * geo.DEGREE).otherwise(F.col("lat")).alias("lat"))
    return rows.select("id", geo.canonical_longitude(F.col("lon"), F.col("lat")).alias("lon"), "lat")


@query("geo_box_wrap", "SELECT id FROM {points} WHERE lat BETWEEN -30000000000 AND 45000000000 AND (lon >= 170000000000 OR lon <= -160000000000) OR abs(lat) = 90000000000 AND lat BETWEEN -30000000000 AND 45000000000")
def geo_box_wrap(spark, m):
    d = geo.DEGREE
    return m["points"].filter(geo.in_box(F.col("lon"), F.col("lat"), F.lit(170 * d), F.lit(-30 * d), F.lit(-160 * d), F.lit(45 * d))).select("id")


@query("local_box", "SELECT id FROM {observations} WHERE x BETWEEN 1000 AND 500000 AND y BETWEEN 250000 AND 800000")
def local_box(spark, m):
    return m["observations"].filter(geo.in_local_box([F.col("x"), F.col("y")], [F.lit(1_000), F.lit(250_000)], [F.lit(500_000), F.lit(800_000)])).select("id")


@query("frame_accepts", "SELECT frame, count(*) FILTER (WHERE frame = 'world') AS fits, count(*) AS n FROM {observations} GROUP BY frame")
def frame_accepts(spark, m):
    return m["observations"].groupBy("frame").agg(F.count_if(geo.frame_accepts(F.col("frame"), F.lit("world"))).alias("fits"), F.count("*").alias("n"))


@query("radius_search", f"SELECT id, round(metres, 3) AS metres FROM (SELECT id, {HAVERSINE} t(id, lon, lat, h)) r(id, metres) WHERE metres <= 2000000.002")
def radius_search(spark, m):
    return space.radius_search(m["points"], 11_500_000_000, 48_100_000_000, 2_000_000.0).select("id", F.round("metres", 3).alias("metres"))


@query("radius_join", """SELECT q.id AS query, p.id AS point FROM {points} q, {points} p WHERE q.id % 50 = 0 AND 2 * 6371007.1809 * asin(least(1.0, sqrt(pow(sin(radians((p.lat - q.lat) / 1e9) / 2), 2) + cos(radians(q.lat / 1e9)) * cos(radians(p.lat / 1e9)) * pow(sin(radians((p.lon - q.lon) / 1e9) / 2), 2)))) <= 300000.002""")
def radius_join(spark, m):
    return space.radius_join(m["points"].filter("id % 50 = 0"), m["points"], 300_000.0).select("query", "point")


@query("knn_nearest", f"SELECT id, CAST(round_even(metres * 1000, 0) AS BIGINT) AS mm FROM (SELECT id, {HAVERSINE} t(id, lon, lat, h)) r(id, metres) ORDER BY mm, id LIMIT 50")
def knn_nearest(spark, m):
    return space.nearest(m["points"], 11_500_000_000, 48_100_000_000, 50)


@query("frame_transform", "SELECT id, CASE id % 4 WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + 1000 AS px, CASE id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END - 500 AS py FROM {observations}")
def frame_transform(spark, m):
    x, y = geo.to_parent(F.col("x"), F.col("y"), F.col("id") % 4, F.lit(1_000), F.lit(-500))
    return m["observations"].select("id", x.alias("px"), y.alias("py"))


@query("geodetic_round_trip", "SELECT id, round(lon / 1e9, 6) AS lon, round(lat / 1e9, 6) AS lat FROM {points} WHERE abs(lat) < 85000000000")
def geodetic_round_trip(spark, m):
    rows = m["points"].filter(F.abs("lat") < 85 * geo.DEGREE)
    lon, lat, _ = geo.ecef_to_geodetic(*geo.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.lit(120.0)))
    return rows.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


STATE = """WITH o AS (SELECT entity, seconds, count(DISTINCT (x, y, frame)) AS places, min((x, y, frame)) AS p FROM {observations} WHERE revision <= 900 GROUP BY entity, seconds),
    e AS (SELECT DISTINCT entity FROM o), a AS (SELECT entity, max(seconds) AS sa FROM o WHERE seconds <= 30000 GROUP BY entity), b AS (SELECT entity, min(seconds) AS sb FROM o WHERE seconds >= 30000 GROUP BY entity),
    j AS (SELECT e.entity, sa, sb, oa.places AS na, ob.places AS nb, oa.p[1] AS ax, oa.p[2] AS ay, oa.p[3] AS af, ob.p[1] AS bx, ob.p[2] AS by_, ob.p[3] AS bf FROM e LEFT JOIN a USING (entity) LEFT JOIN b USING (entity) LEFT JOIN o oa ON oa.entity = e.entity AND oa.seconds = sa LEFT JOIN o ob ON ob.entity = e.entity AND ob.seconds = sb),
    s AS (SELECT *, CASE WHEN sa IS NULL OR sb IS NULL THEN 'unknown' WHEN na > 1 OR nb > 1 THEN 'conflicting' WHEN sa = 30000 THEN 'observed' WHEN af <> bf THEN 'frame_changed' WHEN sb - sa > 14400 THEN 'gap' ELSE 'estimated' END AS status FROM j)
    SELECT entity, status, CASE WHEN status IN ('observed', 'estimated') THEN CAST(CASE WHEN sa = sb THEN ax ELSE ax + floor((bx - ax) * (30000 - sa) / (sb - sa)) END AS BIGINT) END AS x, CASE WHEN status IN ('observed', 'estimated') THEN CAST(CASE WHEN sa = sb THEN ay ELSE ay + floor((by_ - ay) * (30000 - sa) / (sb - sa)) END AS BIGINT) END AS y FROM s"""


@query("state_at_time", STATE)
def state_at_time(spark, m):
    return space.state_at(m["observations"].withColumnRenamed("seconds", "at"), 30_000, 900, max_gap=14_400)


@query("interpolated_position", STATE.replace(" FROM s", " FROM s WHERE status = 'estimated'").replace("SELECT entity, status, ", "SELECT entity, "))
def interpolated_position(spark, m):
    return space.state_at(m["observations"].withColumnRenamed("seconds", "at"), 30_000, 900, max_gap=14_400).filter("status = 'estimated'").select("entity", "x", "y")


@query("conflicting_observations", "SELECT user_id % 20 AS entity, event_id // 40 AS at_time, count(DISTINCT (event_id % 7, event_id % 3)) AS places FROM {events} GROUP BY ALL HAVING count(DISTINCT (event_id % 7, event_id % 3)) > 1")
def conflicting_observations(spark, m):
    rows = m["events"].select((F.col("user_id") % 20).alias("entity"), F.floor(F.col("event_id") / 40).alias("at"), (F.col("event_id") % 7).alias("x"), (F.col("event_id") % 3).alias("y"))
    return space.conflicting(rows).withColumnRenamed("at", "at_time")


@query("kinematics_ticks", "SELECT p_partkey AS id, CAST(t AS BIGINT) AS tick, CAST(round_even((2 * p_size * 16 + 2 * (p_partkey % 50 - 25) * t * 4 + (p_partkey % 7 - 3) * t * t) / 32.0, 0) AS BIGINT) AS p, CAST(round_even(((p_partkey % 50 - 25) * 4 + (p_partkey % 7 - 3) * t) / 4.0, 0) AS BIGINT) AS v FROM {part}, range(0, 11) r(t)")
def kinematics_ticks(spark, m):
    k = F.col("p_partkey")
    return space.motion(m["part"].select(k.alias("id"), F.col("p_size").cast("long").alias("p0"), (k % 50 - 25).alias("v0"), (k % 7 - 3).alias("a")), 10, 4)


BODIES = "SELECT p_partkey AS id, (p_partkey * 37) % 20011 AS p, p_partkey % 21 - 10 AS v, p_partkey % 5 + 1 AS mass, 12 AS size FROM {part}"


@query("contact_solve", f"""WITH b AS ({BODIES}) SELECT a.id AS a_id, c.id AS b_id, round(((a.mass - c.mass) * a.v + 2 * c.mass * c.v) / (a.mass + c.mass), 6) AS a_v_after, round(((c.mass - a.mass) * c.v + 2 * a.mass * a.v) / (a.mass + c.mass), 6) AS b_v_after
    FROM b a JOIN b c ON a.id < c.id AND abs(a.p - c.p) <= 12 AND (c.p - a.p) * (c.v - a.v) < 0""")
def contact_solve(spark, m):
    return space.contacts(_bodies(m)).select("a_id", "b_id", F.round("a_v_after", 6).alias("a_v_after"), F.round("b_v_after", 6).alias("b_v_after"))


@query("contact_pair_order", f"WITH b AS ({BODIES}) SELECT a.id AS a_id, c.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY c.id) AS turn FROM b a JOIN b c ON a.id < c.id AND abs(a.p - c.p) <= 12 AND (c.p - a.p) * (c.v - a.v) < 0")
def contact_pair_order(spark, m):
    return space.rank_pairs(space.contacts(_bodies(m))).select("a_id", "b_id", "turn")


def _bodies(m):
    k = F.col("p_partkey")
    rows = m["part"].select(k.alias("id"), (k * 37 % 20011).alias("p"), (k % 21 - 10).alias("v"), (k % 5 + 1).alias("mass"), F.lit(12).alias("size"))
    return rows.withColumn("cell", F.floor(F.col("p") / 12))


@query("tick_to_utc", "SELECT event_id, CAST(round_even(event_id * 5 / 2.0, 0) AS BIGINT) AS ns FROM {events}")
def tick_to_utc(spark, m):
    return m["events"].select("event_id", timex.tick_to_utc(F.col("event_id"), 5, 2).alias("ns"))


@query("generated_fixture", "SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS last")
def generated_fixture(spark, m):
    return tables.generate(spark, "events", 1_000).agg(F.count("*").alias("n"), F.max("revision").alias("last"))
