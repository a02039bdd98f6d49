"""Fitted operators on labelled tables, search and chat, with odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose

import __spark_entry__ as entry
from marginalia.llm import chat, quality, topk, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, df, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return [(r.score, r.predicted, r[column]) for r in df.filter("held_out").join(labels, "doc_id").collect()]


def area(rows):
    """The chance that a row of label 1 scores above one of label 0."""
    ordered = sorted(rows)
    ones = [i for i, r in enumerate(ordered) if r[2] == 1]
    n1, n0 = len(ones), len(rows) - len(ones)
    return (sum(ones) - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, quality.op1_rank_quality(spark, SF), "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.98 and area(rows) > 0.98


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, toxicity.op10_score_toxicity(spark, SF), "toxic")
    assert np.mean([p == y for _, p, y in rows]) > 0.95 and area(rows) > 0.97


def test_machine_learns_a_meeting_of_terms():
    """Either of two terms alone marks a text, both together do not: no additive weights tell."""
    rng = np.random.default_rng(1)
    texts, toxic = [], []
    for _ in range(600):
        a, b = (int(x < 0.35) for x in rng.random(2))
        texts.append(np.array([1] * a + [2] * b + [10 + k for k in range(3) if rng.random() < 0.5], np.int64))
        toxic.append(bool(a != b))
    machine = toxicity.fit_machine(texts, np.array(toxic), np.ones(600), epochs=150)
    cuts = np.cumsum([0, *map(len, texts)])
    guess = machine.score(np.concatenate(texts), cuts) > 0.5
    assert (guess == np.array(toxic)).mean() > 0.97


def test_machine_learns_terms_that_tell_nothing_alone():
    """Each of two terms stands in half of the texts of either label; toxic when exactly one stands."""
    rng = np.random.default_rng(2)
    texts, toxic = [], []
    for _ in range(800):
        a, b = (int(x < 0.5) for x in rng.random(2))
        texts.append(np.array([1] * a + [2] * b + [10 + k for k in range(30) if rng.random() < 0.4], np.int64))
        toxic.append(bool(a != b))
    machine = toxicity.fit_machine(texts, np.array(toxic), np.ones(800), epochs=150)
    assert machine.place[1] < len(machine.weights) - 1 and machine.place[2] < len(machine.weights) - 1
    guess = machine.score(np.concatenate(texts), np.cumsum([0, *map(len, texts)])) > 0.5
    assert (guess == np.array(toxic)).mean() > 0.97


def test_machine_scores_against_a_loop_over_pairs():
    rng = np.random.default_rng(3)
    place = np.full(toxicity.SLOTS, 20, np.int32)
    place[[5, 7, 9, 11, 13]] = [0, 3, 4, 10, 19]
    weights, vectors = rng.normal(size=21), rng.normal(size=(21, 4))
    weights[20], vectors[20] = 0, 0
    machine = toxicity.Machine(place, 0.3, weights, vectors)
    texts = [[], [5], [5, 7, 13], [4, 6], [5, 7, 9, 11, 13, 15], [7, 8]]
    got = machine.raw(np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)]))
    for text, value in zip(texts, got, strict=True):
        held = [place[x] for x in text if place[x] < 20]
        want = 0.3 + sum(weights[k] for k in held) + sum(vectors[a] @ vectors[b] for i, a in enumerate(held) for b in held[:i])
        assert abs(value - want) < 1e-9


def test_terms_against_a_loop():
    """Equal words and stems have equal slots in all texts, and a text has as many as it has distinct ones."""
    texts = ["Hello hello, WORLD world-wide", None, "", "wörld wör", "hello there", "a" * 40 + " " + "a" * 41, "x y x", prose(5, 400)]
    slots, cuts = toxicity.hashed_terms(pa.array(texts))
    seen = {}
    for text, a, b in zip(texts, cuts, cuts[1:], strict=False):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        words = {w.lower() for w in words}
        terms = {("word", w) for w in words} | {("stem", w[:5]) for w in words if len(w) > 5}
        held = slots[a:b].tolist()
        assert held == sorted(set(held)) and len(held) == len(terms)
        for term in terms:
            seen.setdefault(term, set(held)).intersection_update(held)
    assert all(seen.values())


def test_features_against_a_loop():
    texts = ["The end. Of it, all!\nNext line 42 | x\n", None, "", " \n ", "one", "a a a b a a a b", "ÄÖ ab\tCD$ #1 %", prose(8, 300) + "\n" + prose(8, 60), "w" * 30 + " !!"]
    got = quality.text_features(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        n, size = max(len(words), 1), max(len(raw), 1)

        def share(chars, of=n, raw=raw):
            return sum(c in chars.encode() for c in raw) / of

        upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
        grams = {w: [tuple(words[i : i + w]) for i in range(len(words) - w + 1)] for w in (3, 8)}
        lines = raw.split(b"\n")
        ends = sum(x[-1:] in (b".", b"?", b"!") for x in lines if x)
        want = [
            math.log1p(len(words)), sum(map(len, words)) / n, share("#*$%&<>"), share("|"), share("!"), upper / max(upper + lower, 1),
            share("0123456789", size), share(".?"), share(",;:"), sum(c >= 128 for c in raw) / size, len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, *(1 - len(set(g)) / len(g) if g else 0 for g in grams.values()),
            len(lines) / n, ends / len(lines), sum(len(w) > 24 for w in words) / n,
        ]
        assert np.allclose(row, want), (text, dict(zip(quality.FEATURES, zip(row, want, strict=True), strict=True)))


@pytest.mark.parametrize("labels", [[], [(5, True)], [(5, None)]])
def test_models_without_both_labels(spark, odd, odd_rows, labels):
    preferred = spark.createDataFrame(labels, "doc_id long, preferred boolean")
    ranked = quality.rank_quality(odd, preferred).collect()
    assert len(ranked) == len(odd_rows) and len({r.score for r in ranked}) == 1 and all(0 < r.score < 1 for r in ranked)
    scored = toxicity.score_toxicity(odd, preferred.withColumnRenamed("preferred", "toxic")).collect()
    assert len(scored) == len(odd_rows) and all(0 < r.score < 1 for r in scored)


def test_models_on_empty_tables(spark, none):
    assert quality.rank_quality(none, spark.createDataFrame([(1, True), (2, False)], "doc_id long, preferred boolean")).count() == 0
    assert toxicity.score_toxicity(none, spark.createDataFrame([(1, True), (2, False)], "doc_id long, toxic boolean")).count() == 0


def test_quality_selects_by_quantile(spark):
    rows = [(k, prose(k, 150) if k % 4 else "|| ## $$ " * 60) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 4 != 0) for k in range(80)], "doc_id long, preferred boolean")
    got = quality.rank_quality(df, labels, keep_share=0.75).collect()
    assert {r.doc_id for r in got if r.selected} == {k for k in range(80) if k % 4}


# ---- search


def test_search_against_all_products(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-9, 9, (300, 6))
    vectors[100:120] = vectors[0]  # ties
    rows = [(k, [float(x) / 64 for x in v]) for k, v in enumerate(vectors)]
    rows += [(300, None), (301, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] + [0.0] * 5), (None, [0.0] * 6), (303, [float("inf")] + [0.0] * 5)]
    rows += [(20, rows[20][1]), (304, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = topk.whole_vectors(df)
    got = Counter(tuple(r) for r in topk.top_k_search(whole, whole.filter("vec_id % 20 = 0"), k=7, pivots=4, block_rows=40).collect())
    held = [(k, np.array([int(np.floor(64 * x)) for x in v])) for k, v in rows if k is not None and k < 300]
    want = Counter()
    for q in sorted({k for k, _ in held if k % 20 == 0}):
        vector = dict(held)[q]
        best = sorted((-int(v @ vector), k) for k, v in held if k != q)[:7]
        want.update((q, r + 1, k, -s) for r, (s, k) in enumerate(best))
    assert got == want


def test_search_on_empty_tables(spark):
    none = topk.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k_search(none, none).collect() == []


# ---- chat


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 2, "ann", None), (1, None, None, "first"),
        (2, 0, "system", "alone"), (None, 1, "ann", "x"), (1, 2, "bob", "yo"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as start", "2 as rendered")
    got = chat.render_perspectives(df).collect()
    assert Counter((r.conv_id, r.perspective) for r in got) == {(1, "ann"): 6, (1, "bob"): 6, (1, "unknown"): 6, (None, "ann"): 1}
    for key in {(r.conv_id, r.perspective) for r in got}:
        pieces = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.start)
        whole = "".join(r.rendered for r in pieces)
        for r in pieces:
            assert whole[r.start : r.end] == r.rendered
            if r.role == "assistant":
                assert r.speaker == r.perspective and whole[r.mask_start : r.mask_end].endswith("<|end|>")
            else:
                assert r.mask_start is None and (r.role == "system" or f"name={r.speaker}\n" in r.rendered)
    bob = "".join(r.rendered for r in sorted((r for r in got if r.perspective == "bob"), key=lambda r: r.start))
    assert bob.startswith("<|begin|>user name=unknown\nfirst<|end|>\n<|begin|>system\nbe kind<|end|>\n<|begin|>user name=ann\nhi < |end|>")
    assert chat.render_perspectives(df.limit(0)).count() == 0


# ---- what is registered


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op") and n[2].isdigit()])
def test_query_against_sql(spark, name):
    from compare import compare

    diff, rows, _ = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], "/root/testdata/sf0.001")
    assert diff is None and rows > 0
