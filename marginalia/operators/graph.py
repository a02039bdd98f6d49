"""Class hierarchies, edges and placement as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import cut_lineage


def class_closure(edges: DataFrame, classes: DataFrame, hops: int = 4) -> DataFrame:
    """Every class with itself and all its ancestors, asked of distinct
    classes only. Each round walks up to ``hops`` levels, keeps what is new and
    stops when nothing is; a cycle therefore ends it like a root does.
    No side of a join is broadcast: each of the many joins would send the driver up to the threshold.

    ``edges``: child, parent; ``classes``: class."""
    steps = cut_lineage(edges.select("child", "parent").distinct())
    frontier = cut_lineage(
        classes.select("class").filter("class IS NOT NULL").distinct().withColumn("super", F.col("class"))
    )
    found = frontier
    while True:
        # Paths that meet are one from there on, so each level is made distinct.
        level, reached = frontier, None
        for hop in range(1, hops + 1):
            level = (
                level.join(steps.hint("merge"), level["super"] == steps["child"])
                .select("class", F.col("parent").alias("super"))
                .distinct()
            )
            tagged = level.withColumn("hop", F.lit(hop))
            reached = tagged if reached is None else reached.unionByName(tagged)
        new = cut_lineage(
            reached.groupBy("class", "super").agg(F.min("hop").alias("hop")).join(found.hint("merge"), ["class", "super"], "left_anti")
        )
        if new.isEmpty():
            return found
        found = found.unionByName(new.drop("hop"))
        # Only the deepest level has not been walked on from.
        frontier = new.filter(F.col("hop") == hops).drop("hop")


def descendants(edges: DataFrame, roots: DataFrame, hops: int = 4) -> DataFrame:
    """Every class at or below a root, once per mark, with the mark: the few roots are followed down and every class is reached
    once, however many ways lead there, so the work is that of the edges below the roots and no pairs of classes are kept.

    ``edges``: child, parent; ``roots``: class, mark. A cycle ends like a leaf does; a null class is no root."""
    steps = cut_lineage(edges.select("child", "parent").distinct())
    frontier = cut_lineage(roots.select("class", "mark").filter("class IS NOT NULL").distinct())
    found = frontier
    while True:
        level, reached = frontier, None
        for hop in range(1, hops + 1):
            level = level.join(steps, level["class"] == steps["parent"]).select(F.col("child").alias("class"), "mark").distinct()
            tagged = level.withColumn("hop", F.lit(hop))
            reached = tagged if reached is None else reached.unionByName(tagged)
        new = cut_lineage(
            reached.groupBy("class", "mark").agg(F.min("hop").alias("hop")).join(found, ["class", "mark"], "left_anti")
        )
        if new.isEmpty():
            return found
        found = found.unionByName(new.drop("hop"))
        frontier = new.filter(F.col("hop") == hops).drop("hop")


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Every edge both ways."""
    swapped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped)


def hop_distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fewest steps from the seeds to every node they reach. ``seeds``: id."""
    pairs = cut_lineage(edges.select("src", "dst").distinct())
    seen = cut_lineage(seeds.select("id").distinct().withColumn("dist", F.lit(0).cast("bigint")))
    frontier, dist = seen, 0
    while True:
        dist += 1
        frontier = cut_lineage(
            frontier.select(F.col("id").alias("src"))
            .join(pairs, "src")
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(seen, "id", "left_anti")
            .withColumn("dist", F.lit(dist).cast("bigint"))
        )
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def expand_nodes(
    edges: DataFrame, items: DataFrame, known: DataFrame, frontier: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """One step out from the chosen nodes: the nodes that are new and the
    links to new and known ones. A new node that could hold more (``potential``)
    but has no edges of its own is a leaf. ``items``: id, potential."""
    out = edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    reachable = items.select("id").unionByName(known.select("id")).distinct()
    links = out.join(reachable.select(F.col("id").alias("dst")), "dst", "left_semi")
    opens = edges.select(F.col("src").alias("id")).distinct().withColumn("_opens", F.lit(True))
    nodes = (
        links.select(F.col("dst").alias("id"))
        .distinct()
        .join(known.select("id").distinct(), "id", "left_anti")
        .join(items, "id")
        .join(opens, "id", "left")
        .select(
            "id", "potential",
            (F.col("_opens").isNull() & (F.coalesce("potential", F.lit(0)) > 0)).alias("leaf"),
        )
    )
    return nodes, links


# Authorities that say where something is and nothing else.
GEOGRAPHIC = ("coordinates", "geonames")


def place_items(items: DataFrame, links: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Where each item of a page's graph belongs in the article.

    direct: a section links its entity, a body section before the lede;
    connection: a neighbour is placed directly; prologue or coda: every edge
    rests on geography alone, all of them locations or not; else unplaced.

    ``items``: page_id, item_id, qid; ``links``: page_id, section_ord, ord, qid
    (section 1 is the lede); ``edges``: page_id, src, dst, type, linked_via;
    ``seeds``: page_id, item_id, placed in the lede as the article's subject.

    Instead of joins, rows of both sides are grouped together, each side grouped before where it is large. All keys hold ``page_id``, so what is asked of one
    input alone needs no shuffle where it is dealt by page (``store_by_page``); their unions are dealt anew."""
    item = ["page_id", "item_id"]
    in_lede = (F.col("section_ord") == 1).alias("_lede")
    named = items.filter("qid IS NOT NULL").groupBy("page_id", "qid").agg(F.min("item_id").alias("item_id"))
    first_links = links.dropna(subset=["page_id", "qid"]).groupBy("page_id", "qid").agg(F.min(F.struct(in_lede, "section_ord", "ord", "qid")).alias("p"))
    linked = (
        named.unionByName(first_links, allowMissingColumns=True)
        .groupBy("page_id", "qid")
        .agg(F.min("item_id").alias("item_id"), F.min("p").alias("p"))
        .dropna(subset=["item_id", "p"])
    )
    known = (
        items.select(*item, F.lit(True).alias("_item"))
        .unionByName(linked.select(*item, "p"), allowMissingColumns=True)
        .unionByName(seeds.dropna(subset=item).select(*item, F.lit(True).alias("_seed")), allowMissingColumns=True)
        .groupBy(*item)
        .agg(F.bool_or("_item").alias("_item"), F.bool_or("_seed").alias("_seed"), F.min("p").alias("p"))
        .filter("_item")
        .select(
            *item, "_item", (F.col("_seed").isNotNull() | F.col("p").isNotNull()).alias("_direct"),
            F.when(F.col("_seed"), F.lit(1).cast("bigint")).otherwise(F.col("p.section_ord")).alias("section_ord"),
            F.when(F.col("_seed"), "article subject").otherwise(F.col("p.qid").cast("string")).alias("via"),
        )
    )

    # Edges seen from either end; each edge judged before it is grouped.
    geographic = (F.size("linked_via") > 0) & (
        F.size(F.array_except("linked_via", F.array(*[F.lit(g) for g in GEOGRAPHIC]))) == 0
    )
    both_ways = F.array(
        F.struct(F.col("src").alias("item_id"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("item_id"), F.col("src").alias("other")),
    )
    ends = (
        edges.select("page_id", "src", "dst", geographic.alias("_geo"), (F.col("type") == "location").alias("_loc"))
        .select("page_id", F.inline(both_ways), "_geo", "_loc")
        .dropna(subset=item)
    )
    placed = known.filter("_direct").select("page_id", F.col("item_id").alias("other"), "section_ord", F.lit(True).alias("_placed"))
    there = Window.partitionBy("page_id", "other")
    through = F.when(F.max("_placed").over(there), F.struct((F.col("_at") == 1).alias("_lede"), F.col("_at").alias("section_ord"), "other"))
    around = (
        ends.unionByName(placed, allowMissingColumns=True)
        .withColumn("_at", F.max("section_ord").over(there))
        .withColumn("p", through)
        .filter("_placed IS NULL")
        .groupBy(*item)
        .agg(F.bool_and("_geo").alias("_geo"), F.bool_and("_loc").alias("_loc"), F.min("p").alias("p"))
    )
    geo = F.coalesce("_geo", F.lit(False))
    found = F.col("p").isNotNull() & ~geo
    return (
        known.unionByName(around, allowMissingColumns=True)
        .groupBy(*item)
        .agg(
            F.bool_or("_item").alias("_item"), F.bool_or("_direct").alias("_direct"), F.max("section_ord").alias("section_ord"), F.max("via").alias("via"),
            F.bool_or("_geo").alias("_geo"), F.bool_or("_loc").alias("_loc"), F.min("p").alias("p"),
        )
        .filter("_item")
        .select(
            *item,
            F.when(F.col("_direct"), F.col("section_ord")).when(found, F.col("p.section_ord")).alias("section_ord"),
            F.when(F.col("_direct"), F.col("via")).when(found, F.col("p.other")).alias("via"),
            F.when(F.col("_direct"), "direct").when(geo & F.col("_loc"), "prologue").when(geo, "coda").when(found, "connection")
            .otherwise("unplaced").alias("placement"),
        )
    )


def placement_report(placement: DataFrame) -> DataFrame:
    """Count and share of every placement class."""
    counts = placement.groupBy("placement").agg(F.count("*").alias("items"))
    total = counts.agg(F.sum("items").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(
        "placement", "items", (F.col("items") / F.col("_all")).alias("share")
    )
