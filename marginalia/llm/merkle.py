"""A Merkle manifest of a dataset whose partitions get their upper proofs by a butterfly exchange.

The leaves of a part (a language, say) are put in order and cut into blocks that are aligned with the tree: a block holds
``fanout ** levels`` leaves, so its own subtree needs nothing from elsewhere. Then the blocks swap roots: in round r every block
sends the root of the subtree it stands in to those blocks of the sibling subtrees that stand where it does, and all of them hash
the common ancestor, each for itself. After as many rounds as the tree has upper levels every block holds the part's root and all
siblings on its own way there. Nothing is sent down again. Parts are then the leaves of one more tree, climbed the same way.

A block is one task's work and of bounded size; what is swapped are digests, at most one message per block and sibling."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.ordering import rank_within
from marginalia.llm.crc import CRC_TABLE_SQL, crc_of, crc_sql
from marginalia.llm.registry import query, table
from marginalia.session import cut_lineage

FANOUT = 8
LEVELS = 4  # of a block: 4,096 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: sha256, in lowercase hex, of its framed values."""
    return F.sha2(F.concat(*[framed(c) for c in columns]).cast("binary"), 256)


def folded(digest: Column, before: Column, after: Column) -> Column:
    """The root that a digest leads to with the siblings of every level, those before it and those after it."""
    steps = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    pairs = F.zip_with(before, after, lambda b, a: F.concat(b, a))
    return F.sha2(F.array_join(pairs, "").cast("binary"), 256)


def _up(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[k : k + fanout]).encode()).hexdigest() for k in range(0, len(nodes), fanout)]


def _own_levels(leaves: list[str], first: bool, fanout: int, levels: int) -> list[list[str]]:
    """Nodes of a block by level. A first block that is not full is its part's only one and ends at the root; any other is as
    high as a full one, which ends at one node by itself."""
    out = [leaves]
    while len(out) <= levels and not (first and len(out[-1]) == 1):
        out.append(_up(out[-1], fanout))
    return out


def butterfly(state: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``state`` (part, place, places, digest; others are dropped), one row per block of a part, as root, before, after.

    Round by round a row sends its digest to its like in each sibling subtree; one short of members deals its digests over all
    places there. ``before`` and ``after`` hold, level by level, the joined digests of the siblings on either side."""
    state = state.select(
        "part", "place", "places", "digest", F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after")
    )
    most = state.agg(F.max("places")).first()[0] or 1
    stride = 1
    while stride < most:
        state = cut_lineage(_swap(state, stride, fanout))
        stride *= fanout
    return state.withColumnRenamed("digest", "root").drop("places")


def _swap(state: DataFrame, stride: int, fanout: int) -> DataFrame:
    tree = f"(place div {stride})"
    low = f"(place % {stride})"
    held = f"least({stride}L, places - {tree} * {stride})"  # places in this subtree
    there = f"least({stride}L, places - u * {stride})"  # and in subtree u
    first = f"({tree} - {tree} % {fanout})"
    receivers = F.expr(
        f"flatten(transform(sequence({first}, least({first} + {fanout}, (places + {stride - 1}) div {stride}) - 1), u -> CASE"
        f" WHEN u = {tree} THEN array(place)"
        f" WHEN {low} < {there} THEN transform(sequence({low}, {there} - 1, {held}), l -> u * {stride} + l)"
        f" ELSE array() END))"
    )
    sent = state.select(
        "part", "places", F.explode(receivers).alias("to"), F.expr(tree).alias("tree"), "digest",
        F.struct("place", "before", "after").alias("own"),
    ).withColumn("own", F.when(F.col("own.place") == F.col("to"), F.col("own")))
    met = sent.groupBy("part", F.col("to").alias("place")).agg(
        F.first("places").alias("places"),
        F.array_sort(F.collect_list(F.struct("tree", "digest"))).alias("run"),
        F.first("own", ignorenulls=True).alias("own"),
    )
    mine = F.expr(tree)

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("run", keep), lambda r: r["digest"]), "")

    climbs = F.col("places") > stride
    return met.select(
        "part", "place", "places",
        F.when(climbs, F.sha2(F.array_join("run.digest", "").cast("binary"), 256)).otherwise(F.col("run")[0]["digest"]).alias("digest"),
        F.when(climbs, F.array_append("own.before", joined(lambda r: r["tree"] < mine))).otherwise(F.col("own.before")).alias("before"),
        F.when(climbs, F.array_append("own.after", joined(lambda r: r["tree"] > mine))).otherwise(F.col("own.after")).alias("after"),
    )


def _block_roots(fanout: int, levels: int):
    def run(rows: pa.Table) -> pa.Table:
        rows, first = rows.sort_by("_place"), rows.slice(0, 1)
        top = _own_levels(rows["_leaf"].to_pylist(), first["_block"][0].as_py() == 0, fanout, levels)[-1]
        return pa.table({"part": first["_part"], "place": first["_block"], "digest": pa.array(top, pa.string())})

    return run


def _block_proofs(fanout: int, levels: int):
    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows, over = rows.sort_by("_place"), upper.slice(0, 1).to_pylist()[0]
        nodes = _own_levels(rows["_leaf"].to_pylist(), rows["_block"][0].as_py() == 0, fanout, levels)
        before, after = [], []
        for k in range(len(rows)):
            left, right = [], []
            for level in nodes[:-1]:
                start = k - k % fanout
                left.append("".join(level[start:k]))
                right.append("".join(level[k + 1 : start + fanout]))
                k //= fanout
            before.append(left + over["before"])
            after.append(right + over["after"])
        out = rows.drop_columns(["_part", "_place", "_block", "_leaf"])
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([over[name]] * len(rows), pa.string()))
        for name, held in (("before", before), ("after", after)):
            out = out.append_column(name, pa.array(held, pa.list_(pa.string())))
        return out

    return run


def manifest(rows: DataFrame, part: str, order: str, leaf: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` with subroot (of its part), root (of all), and the proof: before and after, arrays with, for each level from the
    leaf to the root, the joined digests of the siblings to the left and to the right (both empty where a node is alone).

    Columns of these four names are replaced; all others are kept. Rows of a part are ordered by ``order`` (null first), then by
    their digest, so ties and repeated rows give the same tree on every run; each row is a leaf. A null ``part`` is a part of its
    own, the first one. An empty table gives no rows. Leaf digests must not be null."""
    made = ("subroot", "root", "before", "after")
    name = F.when(F.col(part).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(part).cast("string")))
    own = [c for c in rows.columns if c not in made]
    # Digests are written once; the ranges and the trees are made from these small rows.
    kept = cut_lineage(rows.select(*own, name.alias("_part"), F.col(order).alias("_order"), F.col(leaf).alias("_leaf")))
    placed = rank_within(kept, ["_part"], ["_order", "_leaf"], "_place").drop("_order").withColumn("_place", F.col("_place") - 1)
    size = fanout**levels
    placed = placed.withColumn("_block", F.expr(f"_place div {size}"))
    roots = cut_lineage(
        placed.select("_part", "_place", "_leaf", "_block").groupBy("_part", "_block").applyInArrow(
            _block_roots(fanout, levels), "part string, place bigint, digest string"
        )
    )
    sizes = roots.groupBy("part").agg((F.max("place") + 1).alias("places"))
    upper = butterfly(roots.join(sizes, "part"), fanout)
    parts = upper.filter("place = 0").select(F.lit("all").alias("part"), F.col("part").alias("name"), F.col("root").alias("digest"))
    parts = rank_within(parts, ["part"], ["name"], "place").withColumn("place", F.col("place") - 1)
    names = cut_lineage(parts.crossJoin(F.broadcast(parts.agg(F.count("*").alias("places")))))
    tops = butterfly(names, fanout).join(names.select("place", "name"), "place").select(
        F.col("name").alias("part"), F.col("root").alias("top"), F.col("before").alias("top_before"), F.col("after").alias("top_after")
    )
    upper = upper.join(tops, "part").select(
        F.col("part").alias("_part"), F.col("place").alias("_block"), F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("before", "top_before").alias("before"), F.concat("after", "top_after").alias("after"),
    )
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    return placed.groupBy("_part", "_block").cogroup(upper.groupBy("_part", "_block")).applyInArrow(
        _block_proofs(fanout, levels), f"{schema}, subroot string, root string, before array<string>, after array<string>"
    )


def document_manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored) with one part per language:
    doc_id, lang, leaf, altered, subroot, root, before, after.

    ``altered`` is the leaf of a row as tampering leaves it, where a third of the ids (by CRC) has its text lower-cased, A-Z alone;
    without tampering, or with a null id, it is the leaf. Nulls in any column are framed as ``-``; an empty text is ``0:``."""
    columns = {c: F.col(c) for c in FIELDS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = row_digest([*(columns[c] for c in FIELDS[:-1]), lowered])
    leaf = row_digest(list(columns.values()))
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(crc_of(F.col("doc_id")) % 3 == 0, tampered).alias("altered"))
    leaves = leaves.withColumn("altered", F.coalesce("altered", "leaf"))
    return manifest(leaves, "lang", "doc_id", fanout=fanout, levels=levels)


def _framed_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}, '-')"


_HEAD_SQL = " || ".join(_framed_sql(c) for c in FIELDS[:-1])
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Levels are climbed for all parts at once; a finished part stops. Proofs read the runs of every level.
MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS part, sha256({_HEAD_SQL} || {_framed_sql("text")}) AS leaf,
    coalesce({crc_sql("doc_id")} % 3 = 0, false) AS hit, sha256({_HEAD_SQL} || {_framed_sql(_LOWER_SQL)}) AS low
  FROM documents, crc_rule),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
climb(part, level, place, digest, n) AS (
  SELECT part, 0, place, leaf, count(*) OVER (PARTITION BY part) FROM placed
  UNION ALL
  SELECT part, level + 1, place // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + {FANOUT - 1}) // {FANOUT}
  FROM climb WHERE n > 1 GROUP BY part, level, place // {FANOUT}),
subroots AS (SELECT part, digest AS subroot, row_number() OVER (ORDER BY part) - 1 AS place FROM climb WHERE n = 1),
over(level, place, digest, n) AS (
  SELECT 0, place, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, place // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + {FANOUT - 1}) // {FANOUT}
  FROM over WHERE n > 1 GROUP BY level, place // {FANOUT}),
steps AS (
  SELECT p.part, p.place AS leaf_place, c.level, string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < c.place) AS l,
    string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > c.place) AS r
  FROM placed p JOIN climb c ON c.part = p.part AND c.n > 1 AND c.place = p.place // ({FANOUT} ** c.level)::BIGINT
  JOIN climb s ON s.part = c.part AND s.level = c.level AND s.place // {FANOUT} = c.place // {FANOUT}
  GROUP BY p.part, p.place, c.level
  UNION ALL
  SELECT p.part, p.place, 1000 + c.level, string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < c.place),
    string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > c.place)
  FROM placed p JOIN subroots b ON b.part = p.part JOIN over c ON c.n > 1 AND c.place = b.place // ({FANOUT} ** c.level)::BIGINT
  JOIN over s ON s.level = c.level AND s.place // {FANOUT} = c.place // {FANOUT}
  GROUP BY p.part, p.place, c.level),
proofs AS (SELECT part, leaf_place, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} ORDER BY level) AS way FROM steps GROUP BY ALL),
told AS (SELECT p.*, subroot, (SELECT digest FROM over WHERE n = 1) AS root, coalesce(way, []) AS way
  FROM placed p JOIN subroots s ON s.part = p.part LEFT JOIN proofs w ON w.part = p.part AND w.leaf_place = p.place),
done AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,
    list_reduce(list_concat([{{'l': CASE WHEN hit THEN low ELSE leaf END, 'r': ''}}], way),
      lambda d, s: {{'l': sha256(s.l || d.l || s.r), 'r': ''}}).l AS folded_root FROM told)
SELECT *, folded_root = root AS verified FROM done"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tree, the digest of its proof, and whether what tampering left of it still proves."""
    held = document_manifest(table(spark, sf_dir, "documents"))
    root = folded(F.col("altered"), F.col("before"), F.col("after"))
    return held.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
