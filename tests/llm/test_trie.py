"""The trie against a plain one built from dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, depth int, rep string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(role, text) for _, role, _, text in sorted(held)] for c, held in own.items()}
    out = {}
    for c, held in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + held[h:]
    return out


def loop_trie(sequences):
    members = {}
    for c, held in sequences.items():
        for d in range(len(held) + 1):
            members.setdefault(tuple(held[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, held in members.items():
        own = (len(held) - 1) * (len(node[-1][1]) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(sequences[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children.get(node, [])), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got_trie(spark, rows, columns=COLUMNS):
    df = spark.createDataFrame(rows, columns)
    return sorted((tuple(r) for r in trie.prefix_trie(*trie.with_shared_start(trie.sequences(df))).collect()), key=str)


def random_rows(seed, convs, longest, lines):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 3), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"line {rng.randrange(lines)}", 1, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, longest, lines", [(1, 60, 7, 2), (2, 30, 1, 3), (3, 25, 40, 2)])
def test_trie_against_a_loop(spark, seed, convs, longest, lines):
    rows = random_rows(seed, convs, longest, lines)
    assert got_trie(spark, rows) == loop_trie(rebuilt(rows))


def test_trie_of_odd_rows(spark):
    rows = [(100, None, None, None), (100, 1, "user", ""), (100, 1, "user", ""), (101, 1, "user", "Ä\U0001f600b"), (None, 1, "user", "no id")]
    rows += [(102, k, "assistant", "y" * 3000) for k in (3, 1, None)] + [(250, 0, "user", "no base"), (7, 5, None, "alone")]
    rows += [(c, 0, "user", "hello") for c in range(300, 420)]
    rows = [(*r, 5, "z") for r in rows]
    assert got_trie(spark, rows) == loop_trie(rebuilt(rows))


def test_hot_conversation_and_hot_turn(spark, monkeypatch):
    """One conversation holds a third of all turns; half of the others are the same; ids are listed in small pieces."""
    monkeypatch.setattr(trie, "LISTED", 7)
    rows = [(0, t, "user", f"t{t % 3}", 0, "") for t in range(200)]
    rows += [(c, t, "user", "same" if c % 2 else f"own {c} {t}", 0, "") for c in range(1, 100) for t in range(2)]
    assert got_trie(spark, rows) == loop_trie(rebuilt(rows))


def test_trie_of_nothing(spark):
    assert got_trie(spark, []) == []
    assert got_trie(spark, [(None, 1, "user", "x", 1, "y")]) == []


def test_null_roles_are_empty_ones(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (2, 0, "", "x")], "conv_id long, turn long, role string, text string")
    assert trie.sequences(df).select(F.hex("said")).distinct().count() == 1
