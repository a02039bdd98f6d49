"""Joins, readers and streams on small hand-made cases."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from marginalia.operators import graph as G
from marginalia.operators import matching as J
from marginalia.operators import quality as Q
from marginalia.operators import ranking as K
from marginalia.sources import readers as RD
from marginalia.streaming import jobs as S
from marginalia.streaming.runner import file_stream, run_updates


def test_topic_corroboration(spark):
    records = spark.createDataFrame(
        [("p", 1, "q9", ["Moon landings -- History"]), ("p", 2, "q1", ["Lunar landing"]), ("p", 3, "q9", ["Florida"]), ("p", 4, "q9", ["Space craft"])],
        "page_id string, record_id int, own string, subjects array<string>",
    )
    topic = spark.createDataFrame(
        [("p", "q1", "Lunar landing", False), ("p", "q2", "Moon Landing", False), ("p", "q3", "Florida", True), ("p", "q4", "Spacecraft", False)],
        "page_id string, qid string, name string, place boolean",
    )
    assert sorted(r.record_id for r in J.topic_corroboration(records, topic).collect()) == [1, 4]


def test_select_holder_prefers_the_stated_collection(spark):
    claims = spark.createDataFrame(
        [("a", "M1", "normal", 1, "x"), ("a", "M2", "normal", 1, "y"), ("a", "P195", "normal", 1, "C2"),
         ("b", "M1", "deprecated", 1, "x"), ("b", "M2", "normal", 1, "z"), ("c", "M1", "normal", 1, "n"), ("c", "M1", "preferred", 2, "p")],
        "qid string, property string, rank string, ord int, value_id string",
    )
    registry = spark.createDataFrame([("one", "M1", "C1", 0), ("two", "M2", "C2", 1)], "partner string, property string, collection string, ord int")
    got = {r.qid: (r.partner, r.id) for r in J.select_holder(claims, registry).collect()}
    assert got == {"a": ("two", "y"), "b": ("two", "z"), "c": ("one", "p")}


def test_gate_order(spark):
    rows = [(1, "iiif", None, 2, True, "i", "h"), (2, "x", None, 1, True, "i", "h"), (3, "x", "m", 1, False, None, None),
            (4, "x", "m", 1, True, "", "h"), (5, "x", "m", 1, True, "i", None), (6, "x", "m", 1, True, "i", "h"), (None, "x", None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "id int, partner string, institution string, providers int, public_domain boolean, image_url string, href string")
    got = {r.id: r.reason for r in J.gate_failures(df)[0].collect()}
    assert got == {1: "several-institutions", 2: "no-institution", 3: "non-pd-rights", 4: "no-image", 5: "no-object-page", 6: None, None: "no-record"}


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "child int, parent int")
    classes = spark.createDataFrame([(1,), (9,), (7,)], "class int")
    got = {(r["class"], r["super"]) for r in G.class_closure(edges, classes, hops=2).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (9, 9), (9, 1), (9, 2), (9, 3), (7, 7)}


def test_closure_broadcasts_nothing(spark, monkeypatch):
    plans = []

    def cut(df, keep=G.cut_lineage):
        out = keep(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(G, "cut_lineage", cut)
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 200)], "child long, parent long")
    assert G.class_closure(edges, edges.select(edges.child.alias("class")), hops=2).count() == sum(k.bit_length() + 1 for k in range(1, 200))
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)


def test_place_items(spark):
    items = spark.createDataFrame([(1, i, q) for i, q in (("seed", "q0"), ("a", "q1"), ("b", None), ("geo", None), ("coda", None), ("lone", None))], "page_id int, item_id string, qid string")
    links = spark.createDataFrame([(1, 1, 1, "q1"), (1, 3, 1, "q1")], "page_id int, section_ord long, ord int, qid string")
    edges = spark.createDataFrame(
        [(1, "b", "a", "person", ["viaf"]), (1, "seed", "b", "person", ["viaf"]), (1, "geo", "a", "location", ["geonames"]), (1, "coda", "a", "subject", ["coordinates", "geonames"])],
        "page_id int, src string, dst string, type string, linked_via array<string>",
    )
    seeds = spark.createDataFrame([(1, "seed")], "page_id int, item_id string")
    got = {r.item_id: (r.placement, r.section_ord, r.via) for r in G.place_items(items, links, edges, seeds).collect()}
    assert got == {
        "seed": ("direct", 1, "article subject"), "a": ("direct", 3, "q1"), "b": ("connection", 3, "a"),
        "geo": ("prologue", None, None), "coda": ("coda", None, None), "lone": ("unplaced", None, None),
    }


def test_items_of_stored_pages_are_placed_without_a_join(spark):
    from marginalia.sources.pages import drop_stored, store_by_page

    rows = [(page, k, page % 3 + k, k % 4) for page in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, section_ord long, part long, supplier long")
    stored = store_by_page(df, "placement_test", buckets=4)
    part, supplier = F.concat(F.lit("p"), F.col("part")), F.concat(F.lit("s"), F.col("supplier"))

    def placed(rows):
        items = rows.select("page_id", "part").distinct().select("page_id", part.alias("item_id"), F.col("part").alias("qid")).unionByName(
            rows.select("page_id", "supplier").distinct().select("page_id", supplier.alias("item_id")), allowMissingColumns=True
        )
        links = rows.filter("part % 2 = 0").select("page_id", "section_ord", F.lit(1).alias("ord"), F.col("part").alias("qid"))
        edges = rows.groupBy("page_id", "part", "supplier").agg(F.min("section_ord").alias("o")).select(
            "page_id", supplier.alias("src"), part.alias("dst"), F.lit("subject").alias("type"), F.when(F.col("o") % 2 == 0, F.array(F.lit("viaf"))).otherwise(F.array(F.lit("geonames"))).alias("linked_via")
        )
        seeds = rows.groupBy("page_id").agg(F.min("part").alias("part")).select("page_id", part.alias("item_id"))
        return G.place_items(items, links, edges, seeds)

    try:
        found = placed(stored)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, found.collect()))
        assert got == sorted(map(str, placed(df).collect())) and len(got) == len(set(got)) > 200
    finally:
        drop_stored(spark, "placement_test")


def test_card_budgets_map_does_not_take_a_card(spark):
    cards = spark.createDataFrame([(1, 1, i, i, i in (2, 3)) for i in range(1, 8)], "page_id int, section_ord int, anchor_ord int, ord int, is_map boolean")
    assert sorted(r.ord for r in K.card_budgets(cards, 4, 1).collect()) == [1, 2, 4, 5]


def test_hero_needs_something_to_show(spark):
    entries = spark.createDataFrame(
        [(1, 1, 1, "a", "subject-record", False), (1, 1, 2, "a", None, True), (1, 2, 1, "a", "holder-work", True), (1, 3, 1, "a", None, False)],
        "page_id int, section_ord int, ord int, source string, standing string, visual boolean",
    )
    prose = spark.createDataFrame([(1, 1, 900), (1, 2, 10), (1, 3, 900)], "page_id int, section_ord int, prose_chars int")
    hero, rest = K.pick_hero(entries, prose)
    assert {(r.section_ord, r.ord) for r in hero.collect()} == {(2, 1)}
    assert rest.count() == 3


def test_all_issues_of_an_unlinked_article_is_one(spark):
    articles = spark.createDataFrame([("A", "https://fr.wikipedia.org/wiki/A"), ("B", None)], "title string, url string")
    props = spark.createDataFrame([("B", "q")], "title string, qid string")
    hits = spark.createDataFrame([("q", "viaf", i, f"m{i}") for i in range(5)] + [("q", "unregistered", 1, "m")], "qid string, source string, ord int, found string")
    stated = spark.createDataFrame([("q", "gbif", "1")], "qid string, source string, value string")
    results = spark.createDataFrame([("gbif", "1", "HTTP 404 gone")], "source string, value string, error string")
    out = Q.all_issues(articles, props, hits, stated, stated.select("qid", "source"), results, Q.source_registry(spark)).collect()
    assert sorted((r.title, r.issue, r.property or "") for r in out) == [
        ("A", "no-entity", ""), ("B", "broken-link", "P846"), *[("B", "missing-identifier", "P214")] * 3,
    ]


def test_verify_scans_unknown_is_not_disowned(spark):
    works = spark.createDataFrame([("k1", "The Ring", "s1"), ("k2", "Bolt", "s2"), ("k3", "Nut", "s3")], "work_key string, title string, scan_id string")
    scans = spark.createDataFrame([("s1", "Ring Cycle", "k1"), ("s2", "Screw", None)], "scan_id string, scan_title string, scan_work string")
    got = {r.work_key: (r.owned, r.alien) for r in J.verify_scans(works, scans).collect()}
    assert got == {"k1": (True, True), "k2": (False, False), "k3": (None, False)}


def test_iiif_version_two_and_shapes(spark):
    doc = {
        "label": [{"@value": "<b>Old</b> map", "@language": "en"}], "license": ["https://creativecommons.org/publicdomain/zero/1.0/"],
        "sequences": [{"canvases": [{"images": [{"resource": {"service": {"@id": "http://s/1"}}}]}, {}]}], "related": {"@id": "http://page"},
        "attribution": "The Library",
    }
    raw = spark.createDataFrame([(json.dumps(doc), "http://m"), ("not json", "http://n")], "raw string, url string")
    rows = RD.parse_holdings({"iiif": raw}).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.title, r.public_domain, r.image_url, r.href, r.credit, r.image_count) == ("Old map", True, "http://s/1/full/800,/0/default.jpg", "http://page", "The Library", 2)


def test_files_are_read_from_paths(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"results": {"bindings": [{"item": {"value": "http://w/entity/Q5"}}, {"item": {"value": "nope"}}]}}))
    assert [r.item for r in RD.read_sparql_bindings(spark, str(tmp_path), ["item"], "item").collect()] == ["Q5"]
    items = tmp_path / "g" / "items"
    items.mkdir(parents=True)
    (items / "a.json").write_text(json.dumps({"id": "a", "title": "A", "identifiers": {"wikidata": "Q1"}}, indent=1))
    (tmp_path / "g" / "seed.json").write_text(json.dumps({"id": "s", "title": "S"}))
    (tmp_path / "g" / "connections.json").write_text(json.dumps({"s": [{"targetId": "a", "type": "t", "label": "l"}]}, indent=1))
    nodes, edges = RD.read_curated_graph(spark, str(tmp_path / "g"))
    assert {(r.id, r.qid) for r in nodes.collect()} == {("a", "Q1"), ("s", None)}
    assert [(r.src, r.dst, r.linked_via) for r in edges.collect()] == [("s", "a", [])]


def _requests(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, host string, t long, status int, retry_after_s long").withColumn(
            "ts", F.timestamp_seconds("t")
        ).withColumn("duration_s", F.lit(1.0)).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def test_stream_cooloff_over_files_with_a_late_row(spark, tmp_path):
    parts = [
        [(1, "h", 1000, 429, 600), (2, "h", 1100, 200, None)],
        [(3, "h", 1500, 429, 600), (4, "h", 1700, 200, None), (5, "h", 900, 429, 9000)],
        [(6, "h", 1800, 429, None), (7, "h", 1830, 200, None), (8, "h", 1900, 200, None)],
    ]
    path = tmp_path / "in"
    out, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "check"))
    for part in parts:  # one file, one run: the next run starts from the kept state
        _requests(spark, path, [part])
        S.run_cooloff(file_stream(spark, str(path)), out, state, checkpoint)
    got = {r.id: (r.held, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (False, False), 2: (True, False), 3: (True, False), 4: (False, False), 5: (None, True),
        6: (False, False), 7: (True, False), 8: (False, False),
    }


def test_windowed_load_drops_late_rows(spark, tmp_path):
    path = tmp_path / "in"
    day = int(dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp())
    checkpoint, results = str(tmp_path / "check"), {}

    def run():
        def put(batch, n):
            for r in batch.collect():
                results[r.window_start, r.host] = r.requests

        stream = S.windowed_request_load(file_stream(spark, str(path)))
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    _requests(spark, path, [[(1, "h", day, 200, None), (2, "h", day + 60, 429, None)]])
    run()
    _requests(spark, path, [[(3, "h", day + 4 * 3600, 200, None)]])
    run()
    _requests(spark, path, [[(4, "h", day + 3 * 3600 - 7200, 200, None), (5, "h", day + 4 * 3600 + 1, 200, None)]])
    run()
    assert sorted(results.values()) == [2, 2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"h{i % 3}", 1000 * i, 200, None) for i in range(40)]
    path = _requests(spark, tmp_path / "in", [rows[:10], rows[10:25], rows[25:]])
    stream = run_updates(S.windowed_request_load(file_stream(spark, path, files_per_trigger=1)), ["window_start", "host"], "t")
    batch = S.windowed_request_load(spark.read.parquet(path))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_due_for_refresh_waits_for_quiet(spark):
    current = spark.createDataFrame([("a", True), ("b", False)], "title string, complete boolean")
    hosts = spark.createDataFrame([("h",)], "host string")
    assert S.due_for_refresh(current, hosts).count() == 0
    assert [r.title for r in S.due_for_refresh(current, hosts.limit(0)).collect()] == ["b"]


def _ttl_loop(rows, ttl):
    """(hit, late) by id; steps in order, the rows of a step by time."""
    out, until, seen = {}, {}, {}
    for step in rows:
        for event, key, t in sorted(step, key=lambda r: (r[2], r[0])):
            if key in seen and until[key] > seen[key] and t < seen[key]:
                out[event] = (None, True)
                continue
            seen[key] = t
            hit = t < until.get(key, -1)
            if not hit:
                until[key] = t + ttl
            out[event] = (hit, False)
    return out


def test_keyed_times_to_live_over_steps_with_a_restart(spark, tmp_path):
    """Late rows, a busy key, and a query that ends and goes on from its checkpoint; closed intervals leave the state."""
    from marginalia.streaming.keyed import with_keyed_state
    from marginalia.streaming.runner import start_appends

    rng, day = random.Random(6), 1_704_100_000
    steps, event = [], 0
    for k in range(3):
        rows = []
        for _ in range(40):
            event += 1
            rows.append((event, rng.choice(["hot", "hot", "a", "b", f"once{event}"]), day + 3000 * k + rng.randint(-300, 2999)))
        steps.append(rows)
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in steps:  # one file and one run each: what is open is handed over by the state alone
        df = spark.createDataFrame(rows, "event_id long, key string, t long").select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        stream = S.stream_ttl_first_seen(file_stream(spark, path), 1200)
        with_keyed_state(spark, lambda s=stream: start_appends(s, out, checkpoint).awaitTermination())
    read = spark.read.schema(stream.schema).parquet(out)
    assert {r.event_id: (r.hit, r.late) for r in read.collect()} == _ttl_loop(steps, 1200)
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    newest = max(t for rows in steps for _, _, t in rows)
    with_keyed_state(spark, lambda: None)
    ends = [r["value"]["until"] for r in held.collect()]
    assert 0 < len(ends) < 60 and min(ends) > (newest - 3600 - 3000 - 1200) * 1_000_000
    keys = {key for rows in steps for _, key, _ in rows}
    assert len(ends) < len(keys)


def test_cites_settle_by_answer_or_by_time(spark, tmp_path):
    from marginalia.streaming.runner import start_appends

    noon = 1_704_110_400

    def put(name, rows, columns, at):
        df = spark.createDataFrame(rows, columns).withColumn(at, F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    cite, answer = "request long, page_id long, section_ord long, isbn string, has_link boolean, t long", "request long, access string, t long"
    steps = [
        ([(1, 7, 1, "i1", True, noon), (2, 7, 1, "i2", True, noon + 60), (3, 7, 1, None, True, noon)], [(1, "full", noon + 10)]),
        ([(4, 7, 2, "i4", False, noon + 3600)], [(2, "catalog", noon + 60 + 3 * 3600)]),  # an answer three hours late
        ([(None, None, None, None, None, noon + 10 * 86400)], [(4, "full", noon + 3600 + 7 * 3600), (-1, None, noon + 10 * 86400)]),
    ]
    seen = []
    for cites, answers in steps:
        put("cites", cites, cite, "cited_at")
        put("answers", answers, answer, "answered_at")
        streams = [file_stream(spark, str(tmp_path / n)) for n in ("cites", "answers")]
        stream = S.settled_cites(*streams)
        start_appends(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).filter("page_id IS NOT NULL").collect()
        seen.append({(r.section_ord, r.isbn): (r.access, r.unchecked) for r in rows})
    assert seen[0] == {(1, "i1"): ("full", False)}
    assert seen[1] == {(1, "i1"): ("full", False), (1, "i2"): ("catalog", False)}
    assert seen[2] == {**seen[1], (1, None): (None, False), (2, "i4"): (None, True)}


def test_closed_days_leave_the_state_and_stay_in_the_table(spark, tmp_path):
    from marginalia.streaming.runner import start_appends

    noon = 1_704_110_400
    steps = [
        [("a", noon, True, 1), ("b", noon + 5, False, 2), ("a", noon, True, 1)],
        [("c", noon + 2 * 86400, True, 3), ("b", noon - 5 * 86400, True, 9)],
        [("c", noon + 2 * 86400 + 9, False, 4), ("d", noon + 6 * 86400, True, 5)],
    ]
    for rows in steps:
        df = spark.createDataFrame(rows, "title string, t long, complete boolean, render long")
        df.select("title", F.lit("new").alias("build"), F.timestamp_seconds("t").alias("ts"), "complete", "render").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.settled_renders(file_stream(spark, str(tmp_path / "in")), "new")
        query = start_appends(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
    written = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert {(r.title, r.render, r.writes) for r in written.collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 4, 2)}
    assert {(r.title, r.render) for r in S.latest_render(written, "new").collect()} == {("a", 1), ("b", 2), ("c", 4)}
    state = spark.read.format("statestore").option("operatorId", 0).load(str(tmp_path / "check"))
    assert {r["key"]["title"] for r in state.collect()} == {"d"}


def _closure_loop(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for child, parent in edges:
            if child == x and parent not in seen:
                seen.add(parent)
                todo.append(parent)
    return seen


def test_marks_come_down_diamonds_and_cycles_without_the_closure(spark, monkeypatch):
    edges = [(4, 2), (4, 3), (2, 1), (3, 1), (5, 4), (6, 5), (1, 0), (20, 21), (21, 22), (22, 20), (30, 31)] + [(100 + k, 99 + k) for k in range(1, 12)]
    frame = spark.createDataFrame(edges + edges[:3], "child long, parent long")
    roots = spark.createDataFrame([(1, "a"), (3, "b"), (21, "b"), (100, "a"), (None, "a"), (77, "a")], "class long, mark string")
    monkeypatch.setattr(G, "class_closure", None)
    got = {tuple(r) for r in G.descendants(frame, roots).collect()}
    nodes = {x for e in edges for x in e} | {77}
    want = {(n, m) for n in nodes for r, m in [(1, "a"), (3, "b"), (21, "b"), (100, "a"), (77, "a")] if r in _closure_loop(edges, n)}
    assert got == want


def test_census_is_current_only_when_all_of_it_is_written(spark, tmp_path, monkeypatch):
    from marginalia.sources import sinks as SK

    path = str(tmp_path / "census")
    rows = spark.createDataFrame([(1, "p", 10), (1, "q", 11), (2, "p", 12)], "qid long, property string, id long")
    holders, control = rows.groupBy("property").count(), spark.createDataFrame([(5,)], "n long")
    SK.write_census(rows, holders, control, "2026-01-01", path)
    failing = holders.withColumn("count", F.raise_error(F.lit("no")).cast("long"))
    try:
        SK.write_census(rows.limit(1), failing, control, "2026-01-02", path)
        raise AssertionError("the run should have failed")
    except Exception as error:
        assert "no" in str(error)
    held = SK.read_committed(spark, path)
    assert {str(r.queried) for r in held["rows"].collect()} == {"2026-01-01"} and held["rows"].count() == 3
    assert [(r["items"], r["rows"], r["subclass_only"]) for r in held["summary"].collect()] == [(2, 3, 5)]
    SK.write_census(rows.limit(1), holders, control, "2026-01-03", path)
    assert SK.read_committed(spark, path)["rows"].count() == 1


def test_prefixes_across_ranges_against_a_loop(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    prefixes = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["", "zz", "a", "a", texts[0] + "x"]
    values = [(x, (rng.randint(0, 30) if rng.random() > 0.1 else None, i)) for i, x in enumerate(texts)]
    df = spark.createDataFrame(values, "text string, value struct<ord:int,record_id:int>")
    asked = spark.createDataFrame([(p,) for p in prefixes if p], "text string")
    want = {}
    for p in set(prefixes) - {""}:
        some = [v for x, v in values if x.startswith(p)]
        if some:
            want[p] = min(some, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
            got = {r.text: tuple(r.value) for r in J.prefix_first(asked, df).collect()}
            assert got == want, ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert J.prefix_first(asked, df.limit(0)).count() == 0


def test_stored_pages_are_grouped_and_joined_without_a_shuffle(spark):
    from marginalia.operators import measure as M
    from marginalia.sources.pages import drop_stored, store_by_page

    rng = random.Random(2)
    rows = [(k % 97 if k % 50 else None, rng.randint(1, 4), f"s{rng.randint(0, 3)}", rng.choice(["full", None]), k % 3 == 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, section_ord long, source string, access string, has_link boolean").withColumn("unchecked", F.lit(False))
    stored, other = store_by_page(df, "pages_test", buckets=4), store_by_page(df.select("page_id", "source").distinct(), "pages_test", buckets=4)
    try:
        covered = M.citation_coverage(stored).groupBy("page_id").agg(F.sum("total").alias("total"))
        tally = stored.groupBy("page_id", "source").count().join(other.groupBy("page_id").agg(F.max("source").alias("m")), "page_id").join(covered, "page_id")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = tally._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        plain = df.groupBy("page_id", "source").count().join(df.groupBy("page_id").agg(F.max("source").alias("m")), "page_id")
        plain = plain.join(M.citation_coverage(df).groupBy("page_id").agg(F.sum("total").alias("total")), "page_id")
        assert sorted(map(tuple, tally.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        hot = df.withColumn("page_id", F.when(F.rand(1) < 0.4, 1).otherwise(F.col("page_id")))
        assert store_by_page(hot, "pages_test") is hot
    finally:
        assert drop_stored(spark, "pages_test") == 2


def _odd_map(rng, n):
    words = ["plain", "a ],", '],\\"x\\": [{', "]", "\u00e4 \U0001f600", "\\\\", "", "{", '"', "],"]
    out = {}
    for k in range(n):
        key = f"{rng.choice(words)} {k}"
        out[key] = [
            {"targetId": f"t{j}", "type": rng.choice(words), "label": rng.choice(words) * rng.randint(0, 3), "linkedVia": rng.sample(words, rng.randint(0, 3))}
            for j in range(rng.randint(0, 4))
        ]
    return out


def test_json_map_entries_in_any_ranges():
    from marginalia.sources.jsonmap import entries

    rng = random.Random(5)
    for indent in (None, 1, 3):
        for n in (0, 1, 40):
            held = _odd_map(rng, n)
            raw = json.dumps(held, indent=indent, ensure_ascii=indent == 3).encode()
            for width in (1, 7, 64, 500, len(raw)):
                got = []
                for at in range(0, len(raw), width):
                    got += list(entries(lambda a, m, raw=raw: raw[a : a + m], len(raw), at, min(at + width, len(raw))))
                assert [k for k, _ in got] == list(held) and {k: json.loads(v) for k, v in got} == held, (indent, n, width)


def test_connections_are_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(6)
    held = _odd_map(rng, 300)
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "a.json").write_text(json.dumps({"id": "a", "title": "A"}))
    (tmp_path / "seed.json").write_text(json.dumps({"id": "s", "title": "S"}))
    (tmp_path / "connections.json").write_text(json.dumps(held, indent=2), encoding="utf-8")
    _, edges = RD.read_curated_graph(spark, str(tmp_path), split_bytes=4000)
    assert edges.rdd.getNumPartitions() > 5
    want = sorted((k, e["targetId"], e["type"], e["label"], tuple(e["linkedVia"])) for k, v in held.items() for e in v)
    assert sorted((r.src, r.dst, r.type, r.label, tuple(r.linked_via)) for r in edges.collect()) == want
    _, whole = RD.parse_curated_graph(RD.raw_files(spark, str(tmp_path / "seed.json")), RD.raw_files(spark, str(tmp_path / "connections.json")))
    assert whole.count() == len(want)


def test_numbers_of_objects_are_unique_within_their_series(spark):
    objects = spark.createDataFrame([("200100000", None, ""), ("200100000", None, "1"), ("x", "v", "")], "object_id string, visual_id string, series string")
    visuals = spark.createDataFrame([("202100000", "d1", "a", ""), ("202100000", "d2", "b", "1"), ("v", "d3", "c", "")], "visual_id string, digital_id string, rights string, series string")
    digitals = spark.createDataFrame([("d1", "p1"), ("d2", "p2")], "digital_id string, access_point string")
    rows = J.linked_object_chain(objects, visuals, digitals, within=["series"]).collect()
    assert sorted((r.object_id, r.rights, r.access_point) for r in rows) == [("200100000", "a", "p1"), ("200100000", "b", "p2"), ("x", "c", None)]


def test_theses_of_one_wording_are_judged_once(spark):
    """400 subjects and 400 documents of one name, year and place: the block pairs wordings, one here, not 160,000 rows."""
    claims = spark.range(400).selectExpr(
        "stack(3, concat('s', id), 'P1026', 1, concat('t', id), concat('t', id), 'P577', 1, '+1990-00-00T00:00:00Z',"
        " concat('t', id), 'P4101', 1, 'u') AS (qid, property, ord, value)"
    )
    docs = spark.range(400).selectExpr(
        "concat('d', 400 - id) AS identifier", "id AS ord", "'x' AS title", "'Ring, Red' AS creator", "'1990' AS date", "'Small university' AS institution"
    )
    persons = spark.range(400).selectExpr("concat('s', id) AS qid", "'Red Ring' AS name")
    labels = spark.createDataFrame([("u", "University Small")], "qid string, label string")
    out = J.thesis_holding(claims, docs, persons, labels)
    rows = out.collect()
    assert len(rows) == 400 and {(r.identifier, r.evidence) for r in rows} == {("d400", "corroborated")}
    # Both sides of the block are brought to their wordings below the join.
    plan = out._jdf.queryExecution().analyzed().toString()
    below = plan[plan.index("Join Inner, ((_surname"):]
    assert "Aggregate [creator" in below and "Deduplicate" in below


def test_a_log_is_worked_out_once_for_all_its_slices(spark, tmp_path):
    from marginalia.streaming.runner import time_slices

    calls = spark.sparkContext.accumulator(0)

    def seen(i):
        calls.add(1)
        return i

    log = spark.range(40).select(F.udf(seen, "long")("id").cast("timestamp").alias("ts"))
    path = time_slices(log, "ts", 4, str(tmp_path / "log"))
    assert spark.read.parquet(path).distinct().count() == 40 and calls.value == 40
