"""Graph and data-quality jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import graph as G
from marginalia.operators import quality as Q
from marginalia.plans.catalog import query
from marginalia.plans.views import parts_of, sql_over, table, view, with_views
from marginalia.sources.pages import BUCKETS, store_by_page


@query(
    "class_closure",
    f"""{with_views('v_class').replace('WITH', 'WITH RECURSIVE', 1)},
up AS (SELECT DISTINCT l_partkey AS class, l_partkey AS super FROM lineitem UNION SELECT up.class, v.parent FROM up JOIN v_class v ON v.child = up.super)
SELECT class, super FROM up""",
)
def class_closure(spark, sf):
    classes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("class"))
    return G.class_closure(view(spark, sf, "v_class"), classes)


@query("undirected_edges", f"{with_views('v_edges')} SELECT * FROM v_edges UNION ALL SELECT dst, src, type, system FROM v_edges")
def undirected_edges(spark, sf):
    return G.undirected_edges(view(spark, sf, "v_edges"))


@query(
    "hop_distances",
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
d(id, dist) USING KEY (id) AS (SELECT 's' || min(s_suppkey), 0::BIGINT FROM supplier
  UNION SELECT ways.b, d.dist + 1 FROM d JOIN ways ON ways.a = d.id LEFT JOIN recurring.d AS r ON r.id = ways.b WHERE r.id IS NULL)
SELECT id, dist FROM d""",
)
def hop_distances(spark, sf):
    seed = table(spark, sf, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey").cast("string")).alias("id"))
    return G.hop_distances(G.undirected_edges(view(spark, sf, "v_edges")), seed)


GRAPH_ITEMS = "SELECT 'p' || CAST(p_partkey AS STRING) AS id, p_size AS potential FROM part WHERE p_type <> 'LARGE'"
KNOWN = "SELECT 's' || CAST(s_suppkey AS STRING) AS id FROM supplier UNION ALL SELECT 'p' || CAST(p_partkey AS STRING) FROM part WHERE p_size <= 10"
FRONTIER = "SELECT 's' || CAST(s_suppkey AS STRING) AS id FROM supplier WHERE s_acctbal < 2000"


@query(
    "expand_nodes",
    f"""{with_views('v_edges')}, i AS ({GRAPH_ITEMS}), k AS ({KNOWN}), f AS ({FRONTIER}),
l AS (SELECT * FROM v_edges WHERE src IN (SELECT id FROM f) AND (dst IN (SELECT id FROM i) OR dst IN (SELECT id FROM k)))
SELECT dst AS id, NULL AS src, max(potential) AS potential, max(potential) > 0 AS leaf, count(*) * 0 + 1 AS n FROM l JOIN i ON i.id = l.dst WHERE dst NOT IN (SELECT id FROM k) GROUP BY dst
UNION ALL SELECT dst, src, NULL, NULL, count(*) FROM l GROUP BY dst, src""",
)
def expand_nodes(spark, sf):
    nodes, links = G.expand_nodes(
        view(spark, sf, "v_edges"), sql_over(spark, sf, GRAPH_ITEMS), sql_over(spark, sf, KNOWN), sql_over(spark, sf, FRONTIER)
    )
    counted = links.groupBy(F.col("dst").alias("id"), "src").agg(F.count("*").alias("n"))
    return nodes.withColumn("n", F.lit(1).cast("bigint")).unionByName(counted, allowMissingColumns=True)


# A page's graph: the parts its orders cite and who supplied them.
PAGE_EDGES = """SELECT s.page_id, 's' || CAST(l_suppkey AS STRING) AS src, 'p' || CAST(l_partkey AS STRING) AS dst,
  CASE WHEN bool_or(l_linestatus = 'F') THEN 'subject' ELSE 'location' END AS type, min(l_returnflag) AS lo, max(l_returnflag) AS hi
FROM v_sections s JOIN lineitem ON l_orderkey = s.section_id GROUP BY 1, 2, 3"""
PAGE_ITEMS = """SELECT DISTINCT page_id, 'p' || CAST(cand AS STRING) AS item_id, cand AS qid FROM v_cands
UNION ALL SELECT DISTINCT page_id, 's' || CAST(l_suppkey AS STRING), CAST(NULL AS BIGINT) FROM v_sections JOIN lineitem ON l_orderkey = section_id"""
PAGE_LINKS = "SELECT page_id, section_ord, c.ord, value_id AS qid FROM v_sections JOIN v_claims c ON c.qid = section_id WHERE rank = 'preferred'"
PAGE_SEEDS = "SELECT page_id, 'p' || CAST(min(cand) AS STRING) AS item_id FROM v_cands GROUP BY page_id"


# Of an item's links only the section tells, for it has one qid; the line number stands for their order.
PAGE_ROWS = """SELECT page_id, section_ord, l_linenumber AS ord, l_partkey, l_suppkey, l_linestatus, l_returnflag
FROM v_sections JOIN lineitem ON l_orderkey = section_id"""


def placement(spark, sf):
    """All four inputs come from the rows of a page, which are dealt by page once."""
    rows = store_by_page(sql_over(spark, sf, PAGE_ROWS, "v_sections"), "placement", buckets=parts_of(spark, sf, "lineitem") or BUCKETS)
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    system = F.create_map(*[F.lit(x) for x in ("A", "coordinates", "N", "geonames", "R", "viaf")])
    edges = rows.groupBy("page_id", "l_suppkey", "l_partkey").agg(
        F.when(F.bool_or(F.col("l_linestatus") == "F"), "subject").otherwise("location").alias("type"),
        F.array_distinct(F.array(system[F.min("l_returnflag")], system[F.max("l_returnflag")])).alias("linked_via"),
    ).select("page_id", supplier.alias("src"), part.alias("dst"), "type", "linked_via")
    items = rows.select("page_id", "l_partkey").distinct().select("page_id", part.alias("item_id"), F.col("l_partkey").alias("qid")).unionByName(
        rows.select("page_id", "l_suppkey").distinct().select("page_id", supplier.alias("item_id"), F.lit(None).cast("bigint").alias("qid"))
    )
    links = rows.filter("l_returnflag = 'A'").select("page_id", "section_ord", "ord", F.col("l_partkey").alias("qid"))
    seeds = rows.groupBy("page_id").agg(F.min("l_partkey").alias("l_partkey")).select("page_id", part.alias("item_id"))
    return G.place_items(items, links, edges, seeds)


PLACED = f"""{with_views('v_sections', 'v_claims', 'v_cands')}, e AS ({PAGE_EDGES}), i AS ({PAGE_ITEMS}), l AS ({PAGE_LINKS}), sd AS ({PAGE_SEEDS}),
dl AS (SELECT page_id, 'p' || qid AS item_id, CAST(qid AS VARCHAR) AS via, section_ord, row_number() OVER (PARTITION BY page_id, qid ORDER BY section_ord = 1, section_ord, ord) AS n FROM l),
d AS (SELECT page_id, item_id, 1::BIGINT AS section_ord, 'article subject' AS via FROM sd
  UNION ALL SELECT page_id, item_id, section_ord, via FROM dl WHERE n = 1 AND (page_id, item_id) NOT IN (SELECT page_id, item_id FROM sd)),
b AS (SELECT page_id, src AS item_id, dst AS other, type, hi FROM e UNION ALL SELECT page_id, dst, src, type, hi FROM e),
g AS (SELECT page_id, item_id, bool_and(hi <> 'R') AS geo, bool_and(type = 'location') AS loc FROM b GROUP BY 1, 2),
t AS (SELECT b.page_id, b.item_id, d.section_ord, b.other, row_number() OVER (PARTITION BY b.page_id, b.item_id ORDER BY d.section_ord = 1, d.section_ord, b.other) AS n
  FROM b JOIN d ON d.page_id = b.page_id AND d.item_id = b.other),
placed AS (SELECT page_id, item_id, section_ord, via, 'direct' AS placement FROM d
UNION ALL SELECT i.page_id, i.item_id, CASE WHEN NOT geo THEN t.section_ord END, CASE WHEN NOT geo THEN t.other END,
  CASE WHEN geo AND loc THEN 'prologue' WHEN geo THEN 'coda' WHEN t.n IS NOT NULL THEN 'connection' ELSE 'unplaced' END
FROM i JOIN g ON g.page_id = i.page_id AND g.item_id = i.item_id LEFT JOIN t ON t.page_id = i.page_id AND t.item_id = i.item_id AND t.n = 1
WHERE (i.page_id, i.item_id) NOT IN (SELECT page_id, item_id FROM d))"""

query("place_items", f"{PLACED} SELECT * FROM placed")(placement)


@query(
    "placement_report",
    f"{PLACED} SELECT placement, count(*) AS items, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM placed GROUP BY placement",
)
def placement_report(spark, sf):
    return G.placement_report(placement(spark, sf))


# --- data quality ------------------------------------------------------------------

SOURCES = {"P1": "openlibrary", "P2": "internet_archive", "P3": "viaf", "P4": "gbif", "P5": "inaturalist"}
SOURCE_SQL = "CASE property " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in SOURCES.items()) + " ELSE 'other' END"
PROP_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in Q.SOURCE_PROPERTIES.items()) + " END"
HITS = f"SELECT qid, {SOURCE_SQL} AS source, ord, value_id AS found FROM v_claims WHERE rank <> 'preferred'"
STATED = f"SELECT qid, {SOURCE_SQL} AS source, value_id AS value FROM v_claims WHERE rank = 'preferred'"
# A lookup answers with the part's record, unless the part is too small to have one.
RESULTS = f"""SELECT DISTINCT {SOURCE_SQL} AS source, value_id AS value, CASE WHEN p_size <= 5 THEN 'HTTP 404' WHEN p_size <= 10 THEN 'Not found' WHEN p_size <= 15 THEN 'timeout' END AS error
FROM v_claims JOIN part ON p_partkey = value_id"""

MISSING_SQL = f"""miss AS (SELECT qid, source, found, row_number() OVER (PARTITION BY qid, source ORDER BY ord) AS place FROM ({HITS}) h
  WHERE source <> 'other' AND NOT EXISTS (SELECT 1 FROM ({STATED}) s WHERE s.qid = h.qid AND s.source = h.source))"""
BROKEN_SQL = f"""broken AS (SELECT s.qid, s.source, s.value FROM ({STATED}) s JOIN part ON p_partkey = s.value WHERE p_size <= 10 AND source <> 'other')"""


def _parts(spark, sf):
    return (sql_over(spark, sf, q, "v_claims") for q in (HITS, STATED, RESULTS))


@query(
    "missing_identifiers",
    f"""{with_views('v_claims')}, {MISSING_SQL}
SELECT qid, 'missing-identifier' AS issue, source, {PROP_SQL} AS property, CAST(found AS VARCHAR) AS value, place FROM miss WHERE place <= 3""",
)
def missing_identifiers(spark, sf):
    hits, stated, _ = _parts(spark, sf)
    return Q.missing_identifiers(hits, stated, Q.source_registry(spark))


@query(
    "broken_links",
    f"""{with_views('v_claims')}, {BROKEN_SQL}
SELECT qid, 'broken-link' AS issue, source, {PROP_SQL} AS property, CAST(value AS VARCHAR) AS value, NULL::BIGINT AS place FROM broken""",
)
def broken_links(spark, sf):
    _, stated, results = _parts(spark, sf)
    return Q.broken_links(stated, results, Q.source_registry(spark))


ARTICLES = "SELECT o_orderkey AS title, 'https://' || CASE WHEN o_orderstatus = 'F' THEN 'fr' ELSE 'en' END || '.wikipedia.org/wiki/' || CAST(o_orderkey AS STRING) AS url FROM orders"
PROPS = "SELECT DISTINCT l_orderkey AS title, l_orderkey AS qid FROM lineitem"


@query(
    "no_entity",
    f"""WITH a AS ({ARTICLES}) SELECT title, url, CASE WHEN url LIKE 'https://fr%' THEN 'fr' ELSE 'en' END AS lang FROM a WHERE title NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def no_entity(spark, sf):
    return Q.no_entity(sql_over(spark, sf, ARTICLES), sql_over(spark, sf, PROPS))


@query(
    "all_issues",
    f"""{with_views('v_claims')}, {MISSING_SQL}, {BROKEN_SQL},
r AS (SELECT qid, 'missing-identifier' AS issue, source, CAST(found AS VARCHAR) AS value, place FROM miss WHERE place <= 3
  UNION ALL SELECT qid, 'broken-link', source, CAST(value AS VARCHAR), NULL FROM broken)
SELECT qid AS title, qid, issue, source, {PROP_SQL} AS property, value, place FROM r
UNION ALL SELECT o_orderkey, NULL, 'no-entity', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def all_issues(spark, sf):
    hits, stated, results = _parts(spark, sf)
    return Q.all_issues(
        sql_over(spark, sf, ARTICLES), sql_over(spark, sf, PROPS), hits, stated, stated.select("qid", "source"), results,
        Q.source_registry(spark),
    )


ITEMS = "SELECT p_partkey AS item_id, p_brand AS source, CASE WHEN p_size <= 20 THEN p_partkey END AS qid, p_name AS title FROM part"
TITLED = "SELECT DISTINCT title, 1 AS qid FROM v_cites WHERE licensed AND title NOT LIKE 'red%'"


@query(
    "entity_coverage",
    f"""{with_views('v_cites')}, i AS ({ITEMS}), t AS ({TITLED})
SELECT source, CASE WHEN i.qid IS NOT NULL THEN 'stated' WHEN t.title IS NOT NULL THEN 'backfilled' ELSE 'none' END AS state, count(*) AS items
FROM i LEFT JOIN t ON t.title = i.title GROUP BY 1, 2""",
)
def entity_coverage(spark, sf):
    return Q.entity_coverage(sql_over(spark, sf, ITEMS), sql_over(spark, sf, TITLED, "v_cites"))
