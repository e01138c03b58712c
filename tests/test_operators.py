"""Typed errors, vectors, sources, streams, and properties that hold for any history."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import geo, timex
from tessera.operators import asof, graph, ingest, memory, policy, replay, search, space, writes
from tessera.sources import tables
from tessera.streaming import feeds


@pytest.fixture(scope="module")
def versions(spark):
    rng = random.Random(1)
    rows, held = [], {}
    for revision in range(1, 301):
        ident = f"r{rng.randrange(40)}"
        held[ident] = held.get(ident, 0) + 1
        rows.append((ident, "entity", held[ident], revision, rng.choice(["active", "active", "deleted"]), str(revision)))
    return spark.createDataFrame(rows, "id string, kind string, version long, revision long, lifecycle string, payload string").cache()


def test_as_of_equals_a_replayed_dictionary(spark, versions):
    history = sorted(versions.collect(), key=lambda r: r.revision)
    for at in (1, 57, 150, 300):
        state = {r.id: r.version for r in history if r.revision <= at}
        assert {r.id: r.version for r in asof.latest_at(versions, at).collect()} == state
    assert asof.latest_at(versions).exceptAll(asof.latest_at(versions, 300)).isEmpty()


def test_revisions_are_checked(versions):
    with pytest.raises(errors.UnknownReadView):
        asof.record_at(versions, "r1", 301)
    with pytest.raises(errors.HistoryUnavailable):
        asof.resolve_revision(versions, 5, retained_from=10)
    assert asof.resolve_revision(versions, None) == 300


def test_later_knowledge_does_not_leak(versions):
    early = versions.filter("revision <= 100")
    assert asof.latest_at(versions, 100).exceptAll(asof.latest_at(early)).isEmpty()


def test_snapshot_and_suffix_equal_replay(versions):
    for at in (0, 40, 300):
        assert replay.snapshot_plus_suffix(versions, at).exceptAll(asof.latest_at(versions).select(replay.snapshot_plus_suffix(versions, at).columns)).isEmpty()


@pytest.mark.parametrize("status,operation,expected", [(s, o, dict(((a, b), c) for a, b, c in asof.TRANSITIONS).get((s, o))) for s in writes.STATUSES for o in ("accept", "reject", "dispute", "supersede", "retract", "expire")])
def test_transitions(status, operation, expected):
    legal = {("proposed", "accept"), ("proposed", "reject"), ("accepted", "dispute"), ("accepted", "supersede"), ("accepted", "retract"), ("accepted", "expire")}
    assert (expected is not None) == ((status, operation) in legal)


def test_breadth_first_search_equals_python(spark):
    rng = random.Random(2)
    edges = [(f"e{i}", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice(["accepted", "proposed"])) for i in range(80)] + [("loop", "n1", "n1", "accepted"), ("twin1", "n1", "n2", "accepted"), ("twin2", "n1", "n2", "accepted")]
    df = spark.createDataFrame(edges, "rel_id string, src string, dst string, status string")
    for direction in ("out", "in", "either"):
        step = {}
        for _, a, b, s in edges:
            if s == "accepted":
                if direction != "in":
                    step.setdefault(a, []).append(b)
                if direction == "in" or direction == "either" and a != b:
                    step.setdefault(b, []).append(a)
        seen, front, depth, visits = {"n1": 0}, ["n1"], 0, []
        while depth < 3:
            depth += 1
            visits.append(sum(len(step.get(n, [])) for n in front))
            front = sorted({b for a in front for b in step.get(a, [])} - set(seen))
            seen |= {n: depth for n in front}
        got, counts = graph.bfs(df, spark.createDataFrame([("n1",)], "node string"), 3, direction)
        assert {r.node: r.depth for r in got.collect()} == {n: d for n, d in seen.items() if d}
        assert [v for _, _, v in counts] == visits
    with pytest.raises(errors.ResourceLimit):
        graph.bfs(df, spark.createDataFrame([("n1",)], "node string"), 3, "either", max_visits=2)
    with pytest.raises(errors.ResultLimit):
        graph.limited(df, 5)


def test_frame_cycles_are_found(spark):
    frames = spark.createDataFrame([("a", "b", "w"), ("b", "a", "w"), ("c", None, "w"), ("d", "c", "w"), ("e", "d", "x"), ("f", "gone", "w")], "id string, parent string, world string")
    assert {r.id: r.outcome for r in graph.ancestry(frames).collect()} == {"a": "cycle", "b": "cycle", "c": "ok", "d": "ok", "e": "other_world", "f": "missing"}


def test_policy(spark):
    assert policy.replace_policy(3, 3, True) == 4
    with pytest.raises(errors.StaleView):
        policy.replace_policy(3, 2, True)
    with pytest.raises(errors.StaleView):
        policy.check_lease(1, 2, 5, 5)
    records = spark.createDataFrame([(str(i), "main") for i in range(10)], "id string, namespace string")
    grants = spark.createDataFrame([("p", "main", ["read"])], "principal string, namespace string, permissions array<string>")
    denies = spark.createDataFrame([("p", "3")], "principal string, id string")
    assert {r.id for r in policy.allowed(records, grants, denies, "read").collect()} == set("012456789")
    assert policy.allowed(records, grants, denies, "commit").isEmpty()


@pytest.mark.parametrize("lon,lat,expected", [(180, 0, -180), (-180, 0, -180), (45, 90, 0), (45, -90, 0), (181, 0, None), (0, 91, None), (179, 10, 179)])
def test_longitudes(spark, lon, lat, expected):
    d = geo.DEGREE
    got = spark.range(1).select(geo.canonical_longitude(F.lit(lon * d), F.lit(lat * d)).alias("x")).first().x
    assert got == (None if expected is None else expected * d)


@pytest.mark.parametrize("box,point,inside", [((170, -170), (175, 0), True), ((170, -170), (0, 0), False), ((10, 10), (10, 0), True), ((10, 10), (11, 0), False), ((10, 20), (100, 90), True)])
def test_boxes(spark, box, point, inside):
    d = geo.DEGREE
    c = geo.in_box(F.lit(point[0] * d), F.lit(point[1] * d), F.lit(box[0] * d), F.lit(-90 * d), F.lit(box[1] * d), F.lit(90 * d))
    assert spark.range(1).select(c.alias("x")).first().x is inside


def test_one_degree_and_halves(spark):
    r = spark.range(1).select(geo.great_circle_m(F.lit(0), F.lit(0), F.lit(geo.DEGREE), F.lit(0)).alias("m"), timex.tick_to_utc(F.lit(1), 5, 2).alias("a"), timex.tick_to_utc(F.lit(3), 5, 2).alias("b"), space.half_even(F.lit(-5), 2).alias("c")).first()
    assert abs(r.m - 111195.052) < 0.01 and (r.a, r.b, r.c) == (2, 8, -2)


def test_epochs_floor(spark):
    r = spark.range(1).select(timex.epoch(F.lit(-1500).cast("long"), "ms").alias("a"), timex.epoch(F.lit(-500_000_000).cast("long"), "ns").alias("b"), timex.epoch(F.lit(7).cast("long"), "s").alias("c")).first()
    assert (r.a.s, r.a.n, r.b.s, r.b.n, r.c.s, r.c.n) == (-2, 500_000_000, -1, 500_000_000, 7, 0)


def test_radius_join_equals_all_pairs(spark):
    points = tables.generate(spark, "points", 400).cache()
    near = space.radius_join(points, points, 900_000.0)
    every = points.alias("a").join(points.alias("b"), geo.great_circle_m(F.col("b.lon"), F.col("b.lat"), F.col("a.lon"), F.col("a.lat")) <= 900_000.002).select(F.col("a.id").alias("query"), F.col("b.id").alias("point"))
    assert near.select("query", "point").exceptAll(every).isEmpty() and every.exceptAll(near.select("query", "point")).isEmpty()


def test_budgets(spark):
    rows = spark.range(10).select("id", F.lit(100).alias("bytes"))
    assert search.within_budget(rows, 20, 350).select("id", "truncated").collect() == [(0, True), (1, True), (2, True)]
    assert {r.truncated for r in search.within_budget(rows, 10, 1000).collect()} == {False}
    facts = spark.range(10).selectExpr("id", "'Ä Big' as subject", "'p' as predicate", "'v' as value", "'text' as source_text")
    assert search.search_facts(facts, ["BIG", "te"]).count() == 10 and search.search_facts(facts, ["ä"]).count() == 0
    with pytest.raises(errors.ResourceLimit):
        search.search_facts(facts, ["x"], max_candidates=9)


def test_hidden_rows_do_not_change_counts(spark):
    edges = tables.generate(spark, "graph", 200)
    nodes = edges.select(F.col("src").alias("node")).distinct()
    entities = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("lifecycle", F.lit("active"))
    denied = entities.filter("id like '%7'")
    with_hidden = graph.adjacent_authorized(edges, nodes, entities, denied).count()
    removed = graph.adjacent_authorized(edges.join(denied.select(F.col("id").alias("dst")), "dst", "left_anti"), nodes, entities, denied.limit(0)).count()
    assert with_hidden == removed


def test_log_snapshots_and_blobs(spark, tmp_path):
    log = tables.RevisionLog(spark, f"file://{tmp_path}/log", "id long")
    assert log.read().count() == 0
    for r in (1, 2, 3):
        log.append(spark.range(r), r)
    with pytest.raises(errors.Conflict):
        log.append(spark.range(1), 2)
    assert log.read(2, 3).count() == 5 and [r.revision for r in log.read(newest_first=True).collect()][0] == 3
    digest = tables.write_snapshot(spark.range(9), f"file://{tmp_path}/snap", 3)
    assert tables.load_snapshot(spark, f"file://{tmp_path}/snap", 3, digest).count() == 9
    with pytest.raises(errors.HistoryUnavailable):
        tables.load_snapshot(spark, f"file://{tmp_path}/snap", 3, "x")
    (tmp_path / "blob.bin").write_bytes(b"0123456789")
    blobs = tables.read_blobs(spark, f"file://{tmp_path}/blob.bin")
    assert bytes(tables.blob_range(blobs, 3, 4).first().content) == b"3456"
    import hashlib

    chunks = spark.createDataFrame([(0, bytearray(b"ab")), (1, bytearray(b"c"))], "n int, content binary")
    assert tables.stage_blob(spark, chunks, f"file://{tmp_path}/up", hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(errors.Conflict):
        tables.stage_blob(spark, chunks.filter("n = 1"), f"file://{tmp_path}/up", "x")


def test_streams(spark, tmp_path):
    log = tables.RevisionLog(spark, f"file://{tmp_path}/log", "id long")
    for r in (1, 2, 3):
        log.append(spark.range(r * 10), r)
    rows = feeds.subscribe(spark, f"file://{tmp_path}/log", "id long", cursor=1, max_files=1)
    feeds.import_stream(rows, f"{tmp_path}/target", f"{tmp_path}/ledger", f"{tmp_path}/check", "job").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/target").count() == 50
    # nothing new: nothing is written again, and a new revision is taken up where it stopped
    log.append(spark.range(5), 4)
    feeds.import_stream(feeds.subscribe(spark, f"file://{tmp_path}/log", "id long", cursor=1), f"{tmp_path}/target", f"{tmp_path}/ledger", f"{tmp_path}/check", "job").awaitTermination()
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/target").count() == 55 and ledger.agg(F.sum("rows")).first()[0] == 55
    out = feeds.distinct_events(feeds.subscribe(spark, f"file://{tmp_path}/log", "id long"), "id")
    out.writeStream.format("memory").queryName("distinct_events").option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("distinct_events").count() == 30
    with pytest.raises(errors.RetentionGap):
        feeds.subscribe(spark, f"file://{tmp_path}/log", "id long", cursor=1, retained_from=5)


def test_contacts_keep_momentum(spark):
    bodies = tables.generate(spark, "bodies", 300).selectExpr("id", "p0 % 900 as p", "v0 as v", "id % 3 + 1 as mass", "4 as size").withColumn("cell", F.floor(F.col("p") / 4))
    mass = bodies.select("id", "mass", "v")
    met = space.contacts(bodies).join(mass.toDF("a_id", "am", "av"), "a_id").join(mass.toDF("b_id", "bm", "bv"), "b_id")
    assert met.count() > 0 and met.filter("abs(am * av + bm * bv - am * a_v_after - bm * b_v_after) > 1e-6").isEmpty()


def test_html_is_inert(spark):
    pages = spark.createDataFrame([(1, "<p>a <b>b</b></p><script>x()</script><style>y</style>"), (2, None), (3, "<p>open"), (4, "")], "page_id long, html string")
    assert {r.page_id: (r.text, r.outcome) for r in ingest.html_text(pages).collect()} == {1: ("a\nb", "complete"), 2: ("", "malformed"), 3: ("open", "complete"), 4: ("", "complete")}


def test_contract_versions():
    from tessera.contract import WriteContract

    assert WriteContract.negotiate([(0, 9), (1, 0), (2, 0)]) == (1, 0)
    with pytest.raises(ValueError):
        WriteContract.negotiate([(2, 0)])
    with pytest.raises(ValueError):
        WriteContract().write("p", "k", "drop_table", {}, 0)


def test_shortest_path_ties_and_budget(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "d", 1), ("a", "c", 1), ("c", "d", 1), ("a", "d", 2), ("d", "e", 0)], "src string, dst string, cost long")
    got = {r.node: (r.cost, r.hops, r.path) for r in graph.shortest_paths(edges, "a").collect()}
    assert got["d"] == (2, 1, ["a", "d"]) and got["e"] == (2, 2, ["a", "d", "e"]) and got["b"] == (1, 1, ["a", "b"]) and "z" not in got
    with pytest.raises(errors.ResourceLimit):
        graph.shortest_paths(edges, "a", max_visits=2)


def test_time_does_not_follow_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    row = lambda: spark.range(1).select(timex.format_utc(F.lit(1_700_000_000).cast("long"), F.lit(5)).alias("a"), timex.present_in_zone(F.lit(1_700_000_000).cast("long"), "America/New_York").alias("b"), timex.resolve_local(F.lit("2024-07-01 12:00:00"), "America/Chicago")["utc_micros"].alias("c")).first()
    first = row()
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert row() == first == ("2023-11-14T22:13:20.000000005Z", "2023-11-14T17:13:20-05:00[America/New_York]", 1_719_853_200_000_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_claims_beyond_the_limit_are_searched(spark):
    claims = spark.range(300).selectExpr("format_string('c%03d', id) as id", "'s' as subject", "'p' as predicate", "'v' as value", "if(id % 3 = 0, 'The end', 'x') as excerpts", "if(id % 5 = 0, 7L, null) as status_revision")
    want = {f"c{i:03}" for i in range(300) if i % 3 == 0 and i % 5}
    for found in (search.search_claims(claims, ["the"], 7, None), search.search_claims(claims, ["the"], 7)):
        assert {(r.id, r.truncated) for r in found.collect()} == {(i, False) for i in want}
    first = search.search_claims(claims, ["the"], 7, 10).collect()
    assert {r.id for r in first} == set(sorted(f"c{i:03}" for i in range(300) if i % 5)[:10]) & want and all(r.truncated for r in first)


def test_citations_are_byte_slices(spark):
    texts = {"a": "aé€😀z", "b": "plain", "c": "é" * 60, "d": "gone"}
    sources = spark.createDataFrame([(k, 1, t, 9 if k == "d" else None) for k, t in texts.items()], "source string, version long, text string, revoked long")
    cites = [(f"{k}{a}-{b}", k, 1, a, b) for k in texts for a in range(-1, 14) for b in range(-1, 14)]

    def brute(k, a, b):
        raw = texts[k].encode()
        if k == "d":
            return "withheld", None
        if not 0 <= a <= b <= len(raw):
            return "out_of_range", None
        try:
            return "resolved", raw[a:b].decode()
        except UnicodeDecodeError:
            return "not_a_boundary", None

    got = {r.id: (r.outcome, r.excerpt) for r in memory.resolve_citations(spark.createDataFrame(cites, "id string, source string, version long, start int, end int"), sources).collect()}
    assert got == {i: brute(k, a, b) for i, k, _, a, b in cites}


def test_citations_of_all_sources_get_a_row(spark):
    from tessera.plans import registry
    from tessera.plans.project import Model

    m = Model(spark, "/root/testdata/sf0.001")
    assert registry.queries()["citation_excerpt"](spark, m.dir).count() == m["facts"].join(m["documents"], "doc_id").count()


def test_reachability_walks_to_closure(spark):
    chain = spark.range(9).selectExpr("'e' || id as rel_id", "'n' || id as src", "'n' || (id + 1) as dst", "'accepted' as status")
    got = graph.bfs(chain, spark.createDataFrame([("n0",)], "node string"), None, "out")[0]
    assert {r.node: r.depth for r in got.collect()} == {f"n{i}": i for i in range(1, 10)}


@pytest.mark.parametrize("name,table,keys", [("import_batch_outcomes", "events", 0), ("journal_range_scan", "events", 0.85), ("observation_at", "observations", 0.85), ("impact_reachability", "customer", 0), ("line_locator", "conversations", 0)])
def test_queries_cover_their_table(spark, name, table, keys):
    from tessera.plans import registry
    from tessera.plans.project import Model

    m = Model(spark, "/root/testdata/sf0.01")
    rows, of = registry.queries()[name](spark, m.dir).count(), m[table].count()
    assert keys * of < rows < of if keys else rows == of


def test_lines_of_short_and_multibyte_turns(spark, tmp_path):
    from tessera.plans import registry

    texts = ["short", "é " * 40, "a" + "é" * 40, "w " * 30, "\n" * 60 + "x", "😀" * 15 + " "]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def brute(t):
        raw = t.replace(" ", "\n").encode()
        if len(raw) < 60:
            return "out_of_range", None
        try:
            return "resolved", 1 + raw[:60].decode().count("\n")
        except UnicodeDecodeError:
            return "not_a_boundary", None

    assert {r.turn: (r.outcome, r.line) for r in registry.queries()["line_locator"](spark, str(tmp_path)).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_correction_chains_of_any_depth_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(101)] + [(200, 202), (201, 200), (202, 201), (203, 202), (300, 999), (301, 300), (400, 400)]
    want = {i: (0, i, "ok") for i in range(101)} | {i: (None, None, "cycle") for i in (200, 201, 202, 203, 400)} | {300: (999, 1, "missing"), 301: (999, 2, "missing")}
    random.Random(3).shuffle(rows)
    got = asof.correction_chains(spark.createDataFrame(rows, "id long, correction_of long")).collect()
    assert len(got) == len(rows) and {r.id: (r.root, r.depth, r.outcome) for r in got} == want


def test_shortest_paths_have_no_silent_limit_of_hops(spark):
    # a road of 36 cheap steps, and a dear shortcut to its end
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(36)] + [("n0", "n36", 100)], "src string, dst string, cost long")
    got = {r.node: (r.cost, r.hops) for r in graph.shortest_paths(edges, "n0").collect()}
    assert got == {f"n{i}": (i, i) for i in range(37)}
    with pytest.raises(errors.ResourceLimit):
        graph.shortest_paths(edges, "n0", max_hops=3)
    assert graph.shortest_paths(edges.filter("src in ('n0', 'n1', 'n2') and dst <> 'n36'"), "n0", max_hops=3).count() == 4


def test_late_reads_meet_most_of_the_history(spark):
    from tessera.plans import registry
    from tessera.plans.project import Model

    m = Model(spark, "/root/testdata/sf0.01")
    top = asof.current_revision(m["user_versions"])
    seen = registry.queries()["record_at_revision"](spark, m.dir).agg(F.max("revision")).first()[0]
    assert 0.85 * top < seen <= 0.9 * top
    newest = registry.queries()["fact_eligibility_at"](spark, m.dir).agg(F.max(F.substring("id", 2, 20).cast("long"))).first()[0]
    assert newest > 0.8 * asof.current_revision(m["facts"], "recorded")


def test_contacts_of_any_size_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(1, 0.0, 1.0, 1.0, 100.0), (2, 40.0, -1.0, 2.0, 100.0)] + [(i, float(rng.randint(0, 4_000)), float(rng.randint(-5, 5)), 1.0 + i % 3, float(rng.choice([1, 2, 3, 12, 64, 100, 900]))) for i in range(3, 120)]
    bodies = spark.createDataFrame(rows, "id long, p double, v double, mass double, size double")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and abs(a[1] - b[1]) * 2 <= a[4] + b[4] and (b[1] - a[1]) * (b[2] - a[2]) < 0:
                total, push = a[3] * a[2] + b[3] * b[2], 0.5 * (b[2] - a[2])
                want[a[0], b[0]] = ((total + b[3] * push) / (a[3] + b[3]), (total - a[3] * push) / (a[3] + b[3]))
    got = {(r.a_id, r.b_id): (r.a_v_after, r.b_v_after) for r in space.contacts(bodies, restitution=0.5).collect()}
    assert got.keys() == want.keys() and (1, 2) in got and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
    with pytest.raises(errors.ResourceLimit):
        space.contacts(bodies, max_pairs=len(want) - 1)
    assert space.contacts(bodies, max_pairs=len(want)).count() == len(want)


def test_search_is_truncated_only_by_another_candidate(spark):
    claims = spark.createDataFrame([(f"c{i}", "s", "p", "the", "x", None) for i in range(5)], "id string, subject string, predicate string, value string, excerpts string, status_revision long")
    assert [search.search_claims(claims, ["the"], 1, n).filter("truncated").count() for n in (4, 5, 6)] == [4, 0, 0]


def test_budget_without_a_partition(spark):
    rows = spark.range(100).select("id", F.lit(10).alias("bytes")).repartition(7)
    kept = search.within_budget(rows, 8, 55).collect()
    assert sorted(r.id for r in kept) == [0, 1, 2, 3, 4] and all(r.truncated for r in kept)
    assert not any(r.truncated for r in search.within_budget(rows.filter("id < 3"), 8, 55).collect())


def test_grants_join_by_broadcast_or_by_salt(spark, monkeypatch):
    records = spark.range(200).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("main").alias("namespace"))
    grants = spark.createDataFrame([("a", "main", ["read"]), ("b", "main", ["read"]), ("c", "main", ["write"])], "principal string, namespace string, permissions array<string>")
    denies = spark.createDataFrame([("a", "r1"), ("b", "r2")], "principal string, id string")
    few = {(r.principal, r.id) for r in policy.allowed(records, grants, denies, "read").collect()}
    monkeypatch.setattr(policy, "MAX_BROADCAST", 1)
    assert few == {(r.principal, r.id) for r in policy.allowed(records, grants, denies, "read").collect()} and len(few) == 398
    assert policy.allowed(records, grants, denies, "read", ["a"]).count() == 199


def test_html_text_equals_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = ingest.html_text(pages).toPandas()
    assert len(rows) == pages.count()
    text = next(c for c in rows.columns if c not in ("page_id", "url"))
    assert not rows[text].dropna().astype(str).str.contains(r"<(?:p|div|script|style)[ >]", regex=True).any()


def test_years_beyond_four_digits_have_no_sign(spark):
    import duckdb

    seconds = [0, 253402300799, 253402300800, 518_394_000_000, 3_110_364_000_000, -62_135_596_800, -62_167_219_201, -1]
    got = [tuple(r) for r in spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i long, s long").select("i", timex.format_utc(F.col("s"), F.lit(5)).alias("a"), timex.present_in_zone(F.col("s"), "Asia/Kolkata").alias("b")).orderBy("i").select("a", "b").collect()]
    text = "strftime(to_timestamp({s}::BIGINT) AT TIME ZONE '{z}', '%Y-%m-%dT%H:%M:%S')"
    want = [duckdb.sql(f"SELECT {text.format(s=s, z='UTC')} || '.000000005Z', {text.format(s=s, z='Asia/Kolkata')}").fetchall()[0] for s in seconds]
    assert [a for a, _ in got] == [a for a, _ in want]
    assert [b[:-len("+05:30[Asia/Kolkata]")] for _, b in got[:5]] == [b for _, b in want[:5]]  # Kolkata had another offset before 1945


@pytest.mark.parametrize("radius", [300_000.0, 900_000.0, 15_000_000.0])
def test_radius_join_near_poles_equals_all_pairs(spark, radius):
    rng = random.Random(5)
    d = geo.DEGREE
    rows = [(i, rng.randrange(-180 * d, 180 * d + 1), rng.choice((-1, 1)) * rng.randrange(80 * d, 90 * d + 1)) for i in range(700)] + [(700, 0, 90 * d), (701, 180 * d, 0), (702, -180 * d, 0)]
    # just beyond an eighth of the circle, between bands that are cut into eight
    rows += [(703 + 2 * i, -180 * d + 1000, 86_395_000_000 - 1_000_000 * i) for i in range(20)] + [(704 + 2 * i, 180 * d - 46_500_000_000, 86_395_000_000) for i in range(20)]
    points = spark.createDataFrame(rows, "id long, lon long, lat long").cache()
    near = space.radius_join(points, points, radius).select("query", "point")
    every = points.alias("a").join(points.alias("b"), geo.great_circle_m(F.col("b.lon"), F.col("b.lat"), F.col("a.lon"), F.col("a.lat")) <= radius + 0.002).select(F.col("a.id").alias("query"), F.col("b.id").alias("point"))
    assert near.exceptAll(every).isEmpty() and every.exceptAll(near).isEmpty()


def test_search_queries_walk_without_a_visit_limit(spark, monkeypatch):
    from tessera.plans import registry

    limits, bfs = [], graph.bfs

    def spy(*args, max_visits=None):
        limits.append(max_visits)
        return bfs(*args, max_visits=max_visits)

    monkeypatch.setattr(graph, "bfs", spy)
    assert registry.queries()["bfs_depth_4"](spark, "/root/testdata/sf0.001").count() > 0 and limits == [None]


def test_planned_views_equal_their_statements(spark, tmp_path):
    from tessera.plans.project import PLANS, VIEWS, Model

    row = lambda o, p, s, n, q, f: (o, p, s, n, q, 1.0, 0.0, 0.0, None, f)
    rows = [row(1, 2, 3, 1, 5.0, "N"), row(1, 2, 3, 1, 4.0, "A"), row(1, 2, 3, 1, 6.0, "R"), row(1, 2, 3, 2, 4.0, "N"), row(2, 2, 3, 1, 4.0, "N"), row(None, 2, 3, 1, 4.0, "N"), row(4, None, 3, 1, 4.0, "A"), row(4, None, 3, 1, 3.0, None)]
    kinds = ", ".join(["l_orderkey long", "l_partkey long", "l_suppkey long", "l_linenumber int", "l_quantity double", "l_extendedprice double", "l_discount double", "l_tax double", "l_shipdate timestamp_ntz", "l_returnflag string"])
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in PLANS:
        m = Model(spark, str(tmp_path))
        got, want = m[name], spark.sql(VIEWS[name], lineitem=m["lineitem"])
        assert got.dtypes == want.dtypes and got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


def test_numbering_containment_shuffles_hashes_only(spark, monkeypatch):
    from tessera.plans import project

    m = project.Model(spark, "/root/testdata/sf0.001")
    assert "contains" in project.PLANS
    want = spark.sql(project.VIEWS["contains"], lineitem=m["lineitem"])
    for most in (project.MAX_REPEATED, 0):
        monkeypatch.setattr(project, "MAX_REPEATED", most)
        got = project.Model(spark, "/root/testdata/sf0.001")["contains"]
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    near = graph.adjacent_authorized(m["edges"], m["orders"].selectExpr("'order:' || o_orderkey as node"), spark.createDataFrame([], "id string, lifecycle string"), spark.createDataFrame([("c1",)], "id string"))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti, (rel_id" not in plan and plan.index("LeftOuter") < plan.rindex("Inner")  # denied relationships are looked for among the nodes' own


def test_closure_of_ends_in_claims_equals_endpoints(spark, monkeypatch):
    claims = spark.createDataFrame([("a", "accepted", ["e"], ["x", "gone"]), ("b", "proposed", ["no", "e"], ["x", None]), ("c", "retracted", [], ["gone"]), ("d", "accepted", [None, "e", "e"], ["x", "x"])], "id string, status string, evidence array<string>, ends array<string>")
    entities = spark.createDataFrame([("x", "active"), ("gone", "deleted")], "id string, lifecycle string")
    evidence = spark.createDataFrame([("e",)], "id string")
    want = [("a", "inactive_endpoint"), ("b", "inactive_endpoint"), ("b", "missing_evidence"), ("c", "no_evidence"), ("d", "duplicate_evidence"), ("d", "missing_evidence")]
    for most in (writes.MAX_BROADCAST, 0):
        monkeypatch.setattr(writes, "MAX_BROADCAST", most)
        for ends in (None, claims.select("id", F.explode("ends").alias("entity"))):
            assert sorted(map(tuple, writes.closure_violations(claims, ends, entities, evidence).collect())) == want


def test_references_of_records_equal_references(spark):
    from tessera.plans import registry

    rows = spark.createDataFrame([("o1", [("t", "from"), ("t", "to"), ("u", "evidence"), ("t", "from")]), ("o2", [("t", "evidence"), (None, "to"), (None, "from"), ("u", None)]), ("o3", [])], "owner string, refs array<struct<target: string, role: string>>")
    refs = rows.select("owner", F.explode("refs").alias("r")).select("owner", "r.target", "r.role").filter("role is not null")
    got, want = graph.record_references(rows.withColumn("refs", F.filter("refs", lambda r: r["role"].isNotNull()))), graph.reverse_references(refs)
    assert got.count() == want.count() == 4 and got.exceptAll(want).isEmpty()
    plan = registry.queries()["reverse_references"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(target" not in plan


def test_ancestry_rounds_do_not_add_up(spark):
    rows = [(i, i - 1 if i else None, 0) for i in range(12)] + [(20, 21, 0), (21, 20, 0), (30, 99, 0), (40, 1, 1)]
    got = graph.ancestry(spark.createDataFrame(rows, "id long, parent long, world long"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    found = {r.id: (r.root, r.depth, r.outcome) for r in got.collect()}
    assert found[11] == (0, 11, "ok") and found[20] == (21, 1, "cycle") and found[30] == (99, 1, "missing") and found[40] == (1, 1, "other_world")


def test_contacts_are_not_merged_into_few_tasks(spark):
    bodies = spark.range(200).selectExpr("id", "id % 40 as p", "id % 7 - 3 as v", "id % 3 + 1 as mass", "12 as size")
    met = space.contacts(bodies)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2 and met.count() > 0
