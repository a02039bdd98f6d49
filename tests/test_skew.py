"""Paths for groups too large for one task, against plain loops."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions.ordering import rank_within, running_sum
from marginalia.operators.intervals import interval_chain
from marginalia.operators.matching import citation_access, select_holder
from marginalia.operators.measure import partner_tally, request_load
from marginalia.operators.ownership import claim_anchors, claim_citations
from marginalia.operators.ranking import even_sample, pick_diverse, running_budget_cut


def hot_rows(n=400, seed=1):
    """A third of all rows in one group."""
    rng = random.Random(seed)
    return [(("hot" if rng.random() < 0.34 else f"g{rng.randint(0, 9)}"), i, rng.randint(0, 50)) for i in range(n)]


def test_rank_within_split_equals_window(spark):
    df = spark.createDataFrame(hot_rows(), "g string, id long, v int")
    plain = {
        (r.id, r.n)
        for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).collect()
    }
    split = {(r.id, r.n) for r in rank_within(df, ["g"], ["v", "id"], "n").collect()}
    assert plain == split and len(plain) == 400


def test_rank_within_null_group_and_global(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v int")
    got = {(r.g, r.v, r.n) for r in rank_within(df, ["g"], ["v"], "n").collect()}
    assert got == {(None, 1, 1), (None, 3, 2), ("a", 2, 1)}
    assert sorted((r.v, r.n) for r in rank_within(df, [], ["v"], "n").collect()) == [(1, 1), (2, 2), (3, 3)]


def test_running_sum_over_ranges(spark):
    rows = hot_rows(300)
    df = spark.createDataFrame(rows, "g string, id long, v int")
    got = {r.id: r.s for r in running_sum(df, [], ["v", "id"], "v", "s").collect()}
    total = 0
    for _, i, v in sorted(rows, key=lambda r: (r[2], r[1])):
        total += v
        assert got[i] == total


def _claim(rows, cap):
    """(page, section, ord, key) in order; a key of None never owns."""
    out, owned, taken = [], set(), {}
    for page, section, ord_, key in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if taken.get((page, section), 0) >= cap or (key is not None and (page, key) in owned):
            continue
        taken[page, section] = taken.get((page, section), 0) + 1
        if key is not None:
            owned.add((page, key))
        out.append((page, section, ord_, key))
    return sorted(out, key=str)


def _random_claims(seed, nulls):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        page = 1 if rng.random() < 0.34 else rng.randint(2, 12)
        key = None if nulls and rng.random() < 0.2 else rng.randint(0, 25)
        rows.append((page, rng.randint(1, 8), len(rows), key))
    return rows


def test_claims_against_a_loop(spark):
    for seed in (1, 2):
        for nulls, fn, key in ((False, claim_anchors, "cand"), (True, claim_citations, "cite_key")):
            rows = _random_claims(seed, nulls)
            df = spark.createDataFrame(rows, f"page_id long, section_ord long, ord long, {key} long")
            want = _claim(rows, 3)
            got = sorted((tuple(r) for r in fn(df, 3).collect()), key=str)
            assert got == want, (seed, fn.__name__)


def test_claim_anchors_seed_is_open_to_its_owner_alone(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 10), (1, 1, 2, 10), (1, 1, 3, 11), (1, 2, 1, 10), (1, 2, 2, 12)],
        "page_id long, section_ord long, ord long, cand long",
    )
    seeds = spark.createDataFrame([(1, 10, 2)], "page_id long, cand long, owner long")
    got = {(r.section_ord, r.cand) for r in claim_anchors(df, 2, seeds).collect()}
    assert got == {(1, 11), (2, 10), (2, 12)}


def test_claims_example(spark):
    rows = [(1, s, i, ord(c)) for s, cs in ((1, "ABC"), (2, "ACDE"), (3, "EF")) for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "page_id long, section_ord long, ord long, cand long")
    got = sorted((r.section_ord, chr(r.cand)) for r in claim_anchors(df, 2).collect())
    assert got == [(1, "A"), (1, "B"), (2, "C"), (2, "D"), (3, "E"), (3, "F")]


def test_pick_diverse_against_loop(spark):
    rng = random.Random(4)
    rows = {(s, w, m): rng.random() < 0.5 for s in range(20) for w in range(12) for m in range(4) if rng.random() < 0.3}
    link = {(s, w): rng.random() < 0.5 for s in range(20) for w in range(12)}
    df = spark.createDataFrame(
        [(s, w, link[s, w], f"m{m}", m) for s, w, m in rows], "subject long, work long, sitelink boolean, museum string, museum_ord int"
    )
    want = []
    for s in range(20):
        queues = [sorted((w for (a, w, b) in rows if a == s and b == m), key=lambda w: (not link[s, w], w)) for m in range(4)]
        taken, go = [], True
        while go and len(taken) < 5:
            go = False
            for m, q in enumerate(queues):
                nxt = next((w for w in q if w not in [t[0] for t in taken]), None)
                if nxt is not None and len(taken) < 5:
                    taken.append((nxt, f"m{m}"))
                    go = True
        want += [(s, i + 1, w, m) for i, (w, m) in enumerate(taken)]
    got = [(r.subject, r.place, r.work, r.museum) for r in pick_diverse(df, 5).collect()]
    assert sorted(got) == sorted(want)


def _chain(rows):
    out, until = {}, {}
    for key, at, i, length in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        held = at < until.get(key, -1)
        if not held and length is not None:
            until[key] = at + length
        out[i] = (held, until[key] if not held and length is not None else None)
    return out


def test_interval_chain_across_ranges(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [
            ("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", rng.randint(0, 3000), i,
             rng.choice([None, 0, 5, 90, 400]))
            for i in range(600)
        ]
        df = spark.createDataFrame(rows, "key string, at long, id long, length long")
        got = {r.id: (r.held, r.until) for r in interval_chain(df).collect()}
        assert got == _chain(rows), seed


def _with_ranges(spark, monkeypatch, rows, counts):
    """The chain over so many ranges equals the loop, and no more than a few rows a range reach the driver."""
    df = spark.createDataFrame(rows, "key string, at long, id long, length long")
    before, sent = spark.conf.get("spark.sql.shuffle.partitions"), []
    collect, walk = type(df).collect, type(df).toLocalIterator

    def counted(held):
        sent.append(len(held))
        return held

    try:
        for ranges in counts:
            spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
            sent.clear()
            with monkeypatch.context() as m:
                m.setattr(type(df), "collect", lambda self: counted(collect(self)))
                m.setattr(type(df), "toLocalIterator", lambda self, *a: iter(counted(list(walk(self, *a)))))
                chain = interval_chain(df)
            assert sum(sent) <= 3 * ranges, sent
            assert {r.id: (r.held, r.until) for r in chain.collect()} == _chain(rows), ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_even_beat_over_any_number_of_ranges(spark, monkeypatch):
    """A request every 7 s with a length of 61 s: the chain never falls back into step."""
    _with_ranges(spark, monkeypatch, [("a", 7 * i, i, 61) for i in range(900)], (4, 16, 64))


def test_hot_key_with_intervals_longer_than_ranges(spark, monkeypatch):
    """Six hours each, over 64 ranges of some twenty minutes; every row may start one."""
    rng = random.Random(11)
    rows = [("hot", 60 * i + rng.randint(0, 50), i, 6 * 3600) for i in range(1300)]
    rows += [(rng.choice(["a", "z", "zz"]), rng.randint(0, 80_000), 2000 + i, rng.choice([None, 600, 6 * 3600])) for i in range(60)]
    _with_ranges(spark, monkeypatch, rows, (64,))


def test_key_that_starts_late_and_one_that_never_does(spark, monkeypatch):
    rows = [("a", i, i, None if i < 150 or i % 3 else 40) for i in range(400)] + [("b", i, 1000 + i, None) for i in range(100)]
    rows += [("c", i // 9, 2000 + i, 2) for i in range(200)] + [(None, i, 3000 + i, 7) for i in range(60)]
    _with_ranges(spark, monkeypatch, rows, (1, 5, 24))


def test_interval_longer_than_a_range(spark):
    rows = [("a", i, i, 10_000 if i == 0 else 3) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, at long, id long, length long")
    assert interval_chain(df).filter("held").count() == 499


def test_even_sample_positions(spark):
    df = spark.createDataFrame([("a", i) for i in range(17)] + [("b", i) for i in range(3)], "lane string, id int")
    got = sorted((r.lane, r.id) for r in even_sample(df, "lane", "id", 5).collect())
    assert got == [("a", i * 17 // 5) for i in range(5)] + [("b", i) for i in range(3)]


def test_running_budget_cut_only_over_cap(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "at int, size long")
    assert running_budget_cut(df, ["at"], 100).count() == 0
    assert sorted(r["at"] for r in running_budget_cut(df, ["at"], 90).collect()) == [0, 1, 2]


def test_request_load_hot_host(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else "cold", rng.randint(0, 300), rng.randint(0, 40)) for _ in range(300)]
    df = spark.createDataFrame(rows, "host string, t long, d int").select(
        "host", F.timestamp_seconds("t").alias("ts"), F.col("d").cast("double").alias("duration_s")
    )
    got = {r.host: (r.requests, r.peak) for r in request_load(df).collect()}
    for host in ("hot", "cold"):
        mine = [(t, t + d) for h, t, d in rows if h == host]
        peak = max(sum(a <= t < b for a, b in mine) for t in range(400))
        assert got[host] == (len(mine), peak)


def unmerged(spark, df, by):
    """Rows of the largest task when nothing is sent whole and no parts are merged."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return by(df.withColumn("_task", F.spark_partition_id()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cites_without_isbn_are_spread_in_citation_access(spark):
    """All of them would meet in one task."""
    cites = spark.createDataFrame([(k, k % 3 if k < 9 else None) for k in range(1000)], "cite_id int, isbn long")
    volumes = spark.createDataFrame([(0, 1, "full"), (None, 1, "full")], "isbn long, ord long, availability string")
    failed = spark.createDataFrame([(1,), (None,)], "isbn long")
    out = citation_access(cites, volumes, failed)
    assert out.columns == ["cite_id", "isbn", "access", "unchecked"]
    got = {r.cite_id: (r.isbn, r.access, r.unchecked) for r in out.collect()}
    want = {0: (0, "full", False), 1: (1, None, True), 2: (2, None, False)}
    assert got == {k: want[k % 3] if k < 9 else (None, None, False) for k in range(1000)}
    tasks = unmerged(spark, out, lambda df: [r._task for r in df.collect()])
    assert max(tasks.count(t) for t in set(tasks)) < 500


def test_notes_are_not_dealt_by_host_in_partner_tally(spark):
    """Few hosts bear most notes: dealt by host they would meet in as few tasks."""
    cards = spark.createDataFrame([(k, "a") for k in range(50)], "page_id long, source string")
    notes = spark.createDataFrame([(k % 50, "https://www.a.org/x") for k in range(500)], "page_id long, access_url string")
    partners = spark.createDataFrame([("a", "a.org")], "slug string, base string")
    want = {(k, "a", 1, 10) for k in range(50)}
    for parts in (None, 3):
        out = partner_tally(cards, notes, partners, parts=parts)
        assert {(r.page_id, r.slug, r.cards, r.notes) for r in out.collect()} == want
    rows, sent = unmerged(spark, out, lambda df: (df.rdd.getNumPartitions(), df._jdf.queryExecution().executedPlan().toString()))
    assert rows == 3
    assert any("BroadcastHashJoin [host" in line for line in sent.splitlines())


def test_select_holder_deals_rows_to_the_parts_asked_for(spark):
    claims = spark.createDataFrame(
        [(q, p, "normal", k, 7) for q in range(40) for k, p in enumerate(("P1", "P4"))], "qid long, property string, rank string, ord long, value_id long"
    )
    registry = spark.createDataFrame([("a", "P1", 8, 1), ("b", "P4", 7, 2)], "partner string, property string, collection long, ord long")
    for parts in (None, 5):
        out = select_holder(claims, registry, "P4", parts)
        assert {(r.qid, r.partner, r.property, r.id) for r in out.collect()} == {(q, "b", "P4", 7) for q in range(40)}
    assert unmerged(spark, out, lambda df: df.rdd.getNumPartitions()) == 5
