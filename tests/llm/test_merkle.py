"""The manifest against a plain tree, with small fanouts and blocks so that many rounds and ragged runs occur."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves, fanout):
    """Root, and per leaf its siblings by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, place in enumerate(at):
            start = place - place % fanout
            proofs[k].append(("".join(level[start:place]), "".join(level[place + 1 : start + fanout])))
            at[k] = place // fanout
        level = [h("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
    return (level[0] if level else None), proofs


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def loop_manifest(rows, fanout):
    """(doc_id, leaf, altered, subroot, root, proof) of each of (doc_id, text, lang, source, n_chars)."""
    parts = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(framed((doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        altered = h(framed((doc_id, source, lang, n_chars, lowered(text)))) if hit else leaf
        parts.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, altered))
    names = sorted(parts, key=lambda x: b"" if x is None else b"=" + x.encode())
    held = {}
    for name in names:
        parts[name].sort(key=lambda r: r[0])
        held[name] = tree([r[2] for r in parts[name]], fanout)
    root, tops = tree([held[n][0] for n in names], fanout)
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, proofs = held[name]
        out += [(r[1], r[2], r[3], subroot, root, p + top) for r, p in zip(parts[name], proofs, strict=True)]
    return sorted(out, key=str)


def got_manifest(df, **options):
    rows = merkle.document_manifest(df, **options).collect()
    return sorted(((r.doc_id, r.leaf, r.altered, r.subroot, r.root, list(zip(r.before, r.after, strict=True))) for r in rows), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("fanout, levels, count", [(2, 0, 37), (2, 1, 37), (3, 1, 64), (8, 4, 200), (2, 2, 4), (2, 1, 1)])
def test_manifest_against_a_tree(spark, fanout, levels, count):
    langs = ["en", "en", "en", "de", None, "", "zz"]
    rows = [(k * 7, f"Text {k} \u00c4", langs[k % 7 if k % 3 else 0], "s", k) for k in range(count)]
    got = got_manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, levels=levels)
    assert got == loop_manifest(rows, fanout)


def test_manifest_of_odd_rows(odd, odd_rows):
    rows = [r[:5] for r in odd_rows]
    assert got_manifest(odd, fanout=3, levels=1) == loop_manifest(rows, 3)


def test_tampering_shows_where_text_changes(spark):
    rows = [(k, "Abc" if k % 2 else "abc", "en", None, 3) for k in range(40)] + [(2**53 + 1, None, None, None, None)]
    held = merkle.document_manifest(spark.createDataFrame(rows, SCHEMA))
    folded = merkle.folded(F.col("altered"), F.col("before"), F.col("after"))
    for r in held.withColumn("ok", folded == F.col("root")).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2 and r.doc_id < 40
        assert r.ok == (not changed), r.doc_id


def test_manifest_of_nothing_and_of_clashing_columns(spark, none):
    assert merkle.document_manifest(none).count() == 0
    rows = [(k, h(str(k)), "x", "y", 5, 6) for k in range(9)]
    df = spark.createDataFrame(rows, "place long, leaf string, part string, root string, before long, digest long")
    got = merkle.manifest(df, "part", "place", fanout=2, levels=1)
    assert got.columns == ["place", "leaf", "part", "digest", "subroot", "root", "before", "after"]
    root, _ = tree([r[1] for r in rows], 2)
    assert {(r.subroot, r.root) for r in got.collect()} == {(root, root)}
