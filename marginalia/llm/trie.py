"""Prefix trie of conversations by van Emde Boas recursion.

Sequences of turns are cut at half depth. Equal upper halves get one name, that of the smallest conversation among them, which is
also the name of the node at the cut. Named, each upper half goes on once, with the number of conversations behind it; lower
halves go on in the forest under the node they were cut from. Upper trie and lower forests are halved alike, all in the same
step, so after as many steps as the depth has binary digits every piece is one turn: a node, with its parent's name.

Totals come the other way. Every piece of one turn knows its own. When halves are joined again, the totals of the trees in a lower
forest are grafted onto the upper piece they hang from, and each node along that piece gets them; one step a round.

No sequence is ever gathered: its turns are rows, and what a half holds is told by digests that are summed up before they
travel. A conversation with a third of all turns is cut like any other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.ordering import rank_within
from marginalia.llm.crc import CRC_TABLE_SQL, crc_of, crc_sql
from marginalia.llm.registry import query, table
from marginalia.session import cut_lineage

SHARING = 100  # conversations that share their base
CHOICES = 6  # of what they take from it: 0 to 5 turns
LISTED = 4096  # ids that are joined into one string at a time


def sequences(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; other columns are ignored) as conv_id, depth (from 1), said (digest of role and text)
    and size (code points of the text).

    Turns are ordered by number (null first), role, and digest; null role or text counts as empty; repeated rows are turns each. A
    null conv_id is no conversation: such rows are left out. An empty table gives no rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.sha2(framed.cast("binary"), 256).alias("said"), F.length(text).cast("bigint").alias("size"),
    )
    return rank_within(cut_lineage(rows), ["conv_id"], ["turn", "role", "said"], "depth").select(
        "conv_id", "depth", F.unhex(F.substring("said", 1, 32)).alias("said"), "size"
    )


def with_shared_start(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences that begin with the first turns of their base, conversation c - c % 100, as many as a CRC of their id says (0 to 5),
    and go on with their own turns after as many; and the ids of all conversations, those left without a turn among them.

    A base that has fewer turns gives all, one that is not there none."""
    asked = (crc_of(F.col("conv_id")) % CHOICES).alias("asked")
    convs = rows.filter("depth = 1").select("conv_id", asked, (F.col("conv_id") - F.col("conv_id") % SHARING).alias("base"))
    starts = rows.filter((F.col("conv_id") % SHARING == 0) & (F.col("depth") < CHOICES)).withColumnRenamed("conv_id", "base")
    given = convs.join(starts, "base").filter("depth <= asked").select("conv_id", "depth", "said", "size")
    held = starts.groupBy("base").agg(F.max("depth").alias("held"))
    # Only a base shorter than what is asked of it moves the turns after it.
    short = convs.join(held, "base", "left").select("conv_id", (F.col("asked") - F.coalesce("held", F.lit(0))).alias("less")).filter("less > 0")
    own = rows.withColumn("asked", asked).filter("depth > asked").join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("depth") - F.coalesce("less", F.lit(0))).alias("depth"), "said", "size")
    return cut_lineage(given.unionByName(own)), convs.select("conv_id")


def _content(keep: Column | None = None) -> list[Column]:
    """Aggregates that tell the turns of a group apart from other turns or other depths: two digests and a count."""
    one, two = F.xxhash64("depth", "said"), F.xxhash64(F.lit(23209), "said", "depth")
    if keep is not None:
        one, two = F.when(keep, one), F.when(keep, two)
    return [
        F.coalesce(F.bit_xor(one), F.lit(0)).alias("one"), F.coalesce(F.bit_xor(two), F.lit(0)).alias("two"), F.count(one).alias("turns"),
    ]


SAME = ["one", "two", "turns"]


def _digests_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the joined ids of every key; pieces come sorted by key and number, and only one is held at a time."""
    key, running = None, None
    for batch in batches:
        keys, digests = [], []
        for one, two, turns, ids in zip(*(batch.column(c).to_pylist() for c in (*SAME, "ids")), strict=True):
            if (one, two, turns) == key:
                running.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                digests.append(running.hexdigest())
            key, running = (one, two, turns), hashlib.sha256(ids.encode())
        yield _listed(keys, digests)
    if key is not None:
        yield _listed([key], [running.hexdigest()])


def _listed(keys: list[tuple[int, int, int]], digests: list[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], [*SAME, "ends_sha256"])


def _ends(whole: DataFrame) -> DataFrame:
    """Per content: digest of the ascending ids of the conversations that hold it. A digest is a chain, so the ids of one content
    end in one task; they get there as strings of up to LISTED ids, one after the other."""
    ranked = rank_within(whole, SAME, ["conv_id"], "_rank").withColumn("_piece", F.expr(f"(_rank - 1) div {LISTED}"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ranked.groupBy(*SAME, "_piece").agg(ids.alias("ids"))
    sorted_ = pieces.repartition(*[F.col(c) for c in SAME]).sortWithinPartitions(*SAME, "_piece").select(*SAME, "ids")
    return sorted_.mapInArrow(_digests_of_lists, "one bigint, two bigint, turns bigint, ends_sha256 string")


def _halved(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of ``width`` depths cut in two: the rows of their halves, each upper half once, and the name of every piece's upper half."""
    half = width // 2
    upper = F.col("depth") <= F.col("part") * width + half
    pieces = rows.groupBy("part", "rep").agg(F.first("forest").alias("forest"), F.first("convs").alias("convs"), *_content(upper))
    named = pieces.groupBy("part", "forest", *SAME).agg(F.min("rep").alias("name"), F.sum("convs").alias("behind"))
    names = cut_lineage(pieces.join(named, ["part", "forest", *SAME]).select("part", "rep", "name", "behind"))
    cut = rows.join(names, ["part", "rep"]).filter(~upper | (F.col("rep") == F.col("name")))
    below = (~upper).cast("bigint")
    out = cut.select(
        (F.col("part") * 2 + below).alias("part"), "rep", "depth", "said", "size",
        F.when(upper, F.col("forest")).otherwise(F.col("name")).alias("forest"),
        F.when(upper, F.col("behind")).otherwise(F.col("convs")).alias("convs"),
    )
    return cut_lineage(out), names.select("part", "rep", "name")


def _paths_joined(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes along the pieces that were cut, from those along their halves."""
    upper = paths.filter("part % 2 = 0").select(F.expr("part div 2").alias("part"), F.col("rep").alias("name"), "depth", "node")
    lower = paths.filter("part % 2 = 1").select(F.expr("part div 2").alias("part"), "rep", "depth", "node")
    return cut_lineage(names.join(upper, ["part", "name"]).select("part", "rep", "depth", "node").unionByName(lower))


def _grafted(totals: DataFrame, paths: DataFrame, width: int) -> DataFrame:
    """Totals of the nodes within pieces of ``width`` depths, from those within their halves."""
    half = width // 2
    trees = totals.filter((F.col("depth") - 1) % width == half)
    forests = trees.groupBy(F.col("parent").alias("rep"), F.expr(f"(depth - 1) div {half} - 1").alias("part")).agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    onto = paths.join(forests, ["part", "rep"]).select(
        "depth", F.col("node").alias("conv_id"), F.lit(None).cast("bigint").alias("parent"), "saved", "leaves"
    )
    both = totals.unionByName(onto).groupBy("depth", "conv_id")
    return cut_lineage(both.agg(F.max("parent").alias("parent"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (conv_id, depth from 1 without gaps, said, size) over the conversations ``convs`` (conv_id,
    distinct): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is named by its smallest conversation and its depth. saved_tokens sums, over its subtree, the size of the last turn for
    every conversation but one. The root (depth 0) holds conversations without turns too. Without conversations there is no node."""
    content = rows.groupBy("conv_id").agg(*_content())
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SAME]
    whole = cut_lineage(convs.join(content, "conv_id", "left").select("conv_id", *zero))
    first = whole.filter("turns > 0").groupBy(*SAME).agg(F.min("conv_id").alias("rep"), F.count("*").alias("convs"))
    first = cut_lineage(first)
    found = whole.agg(F.min("conv_id"), F.count("*"), F.max("turns")).first()
    smallest, every, deepest = found[0], found[1], found[2] or 0
    width = 1
    while width < deepest:
        width *= 2
    live = rows.join(first.select(F.col("rep").alias("conv_id"), "convs"), "conv_id").select(
        F.lit(0).cast("bigint").alias("part"), F.col("conv_id").alias("rep"), "depth", "said", "size",
        F.lit(smallest).cast("bigint").alias("forest"), "convs",
    )
    live, cuts = cut_lineage(live), []
    while width > 1:
        live, names = _halved(live, width)
        cuts.append((width, names))
        width //= 2
    nodes = live.select("depth", F.col("rep").alias("conv_id"), F.col("forest").alias("parent"), "convs", "size")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")))
    totals = nodes.select(
        "depth", "conv_id", "parent", ((F.col("convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaves")
    )
    paths = live.select("part", "rep", "depth", F.col("rep").alias("node"))
    for width, names in reversed(cuts):
        totals = _grafted(totals, paths, width)
        paths = _paths_joined(paths, names)
    ends = _ends(whole).join(first, SAME, "left")
    ends = ends.join(paths.select("rep", F.col("depth").alias("turns"), "node"), ["rep", "turns"], "left").select(
        F.col("turns").alias("depth"), F.coalesce("node", F.lit(smallest)).cast("bigint").alias("conv_id"), "ends_sha256"
    )
    below = nodes.filter("depth = 1").agg(F.count("*").alias("n_children"))
    tops = totals.filter("depth = 1").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    root = below.crossJoin(F.broadcast(tops)).select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(smallest).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("parent"),
        F.lit(every).cast("bigint").alias("convs"), "n_children",
        F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    ).filter("convs > 0")
    all_nodes = nodes.select("depth", "conv_id", "parent", "convs", "n_children").join(
        totals.select("depth", "conv_id", "leaves", "saved"), ["depth", "conv_id"]
    ).unionByName(root)
    return all_nodes.join(ends, ["depth", "conv_id"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("convs").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


TRIE_SQL = f"""
WITH {CRC_TABLE_SQL},
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, ''))::BIGINT AS size,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, said, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS depth FROM said),
convs AS (SELECT conv_id, {crc_sql("conv_id")} % {CHOICES} AS asked, conv_id - conv_id % {SHARING} AS base FROM (SELECT DISTINCT conv_id FROM turns), crc_rule),
held AS (SELECT c.conv_id, asked, base, least(asked, (SELECT count(*) FROM turns t WHERE t.conv_id = c.base)) AS held FROM convs c),
rebuilt AS (SELECT h.conv_id, t.depth, t.said, t.size FROM held h JOIN turns t ON t.conv_id = h.base AND t.depth <= h.asked
  UNION ALL SELECT h.conv_id, t.depth - h.asked + h.held, t.said, t.size FROM held h JOIN turns t ON t.conv_id = h.conv_id AND t.depth > h.asked),
paths AS (SELECT conv_id, depth, size, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (SELECT path, depth::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY path, depth),
children AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
above AS (SELECT left(path, 64 * d) AS path, own, n_children FROM (SELECT path, own, n_children, unnest(range(0, depth + 1)) AS d FROM own)),
totals AS (SELECT path, sum(own)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY path)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, leaves AS n_leaves, saved AS saved_tokens, o.ends_sha256
FROM own o JOIN totals t ON t.path = o.path LEFT JOIN nodes p ON o.depth > 0 AND p.depth = o.depth - 1 AND p.path = left(o.path, 64 * (o.depth - 1))"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_start(sequences(table(spark, sf_dir, "conversations"))))
