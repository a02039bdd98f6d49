"""Joins, gates and resolution over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.identifiers import host_of
from marginalia.operators import matching as J
from marginalia.operators import measure as M
from marginalia.operators import rights as R
from marginalia.plans.catalog import query
from marginalia.plans.views import parts_of, sql_over, table, view, with_views
from marginalia.sources.batches import lookup_batches

HOLD = with_views("v_holdings")
CITES = with_views("v_cites")


@query(
    "gate_failures",
    f"""{HOLD}, g AS (SELECT partner, CASE WHEN href IS NOT NULL THEN 'obj.example' END AS host,
  CASE WHEN institution IS NULL THEN CASE WHEN editions > 40 AND partner = 'Brand#7' THEN 'several-institutions' ELSE 'no-institution' END
    WHEN NOT public_domain THEN 'non-pd-rights' WHEN image_url IS NULL THEN 'no-image' WHEN href IS NULL THEN 'no-object-page' END AS reason FROM v_holdings)
SELECT partner, host, reason, count(*) AS n, CAST(grouping(partner) * 4 + grouping(host) * 2 + grouping(reason) AS BIGINT) AS "grouping"
FROM g GROUP BY ROLLUP (partner, host, reason)
UNION ALL SELECT partner, host, reason, count(*), -1 FROM g WHERE reason IS NULL GROUP BY ALL""",
)
def gate_failures(spark, sf):
    holdings = view(spark, sf, "v_holdings").withColumn(
        "providers", F.when(F.col("editions") > 40, 2).otherwise(1)
    ).withColumn("partner", F.when(F.col("partner") == "Brand#7", "iiif").otherwise(F.col("partner")))
    judged, counts = J.gate_failures(holdings)
    passing = judged.filter("reason IS NULL").groupBy("partner", host_of(F.col("href")).alias("host"), "reason").agg(
        F.count("*").alias("n"), F.lit(-1).cast("bigint").alias("grouping")
    )
    return counts.unionByName(passing).withColumn("partner", F.when(F.col("partner") == "iiif", "Brand#7").otherwise(F.col("partner")))


GEO = """SELECT qid, CASE WHEN c_acctbal < 0 THEN '<http://globe.example/Q405> ' ELSE '' END AS globe, lon, lat,
  c_mktsegment <> 'MACHINERY' AS place, c_mktsegment = 'FURNITURE' AND c_acctbal > 5000 AS defunct,
  CASE WHEN c_acctbal > 7000 THEN concat('w', CAST(qid AS STRING)) END AS osmw,
  CASE WHEN c_acctbal > 3000 THEN concat('n', CAST(qid AS STRING)) END AS osmn,
  CASE WHEN c_acctbal > 1000 THEN concat('r', CAST(qid AS STRING)) END AS osmr
FROM v_geo JOIN customer ON c_custkey = qid"""


@query(
    "mappable",
    f"""{with_views('v_geo')}, g AS ({GEO}), k AS (SELECT * FROM g WHERE place AND NOT defunct),
t AS (SELECT *, CASE WHEN osmw IS NOT NULL THEN 'way' WHEN osmn IS NOT NULL THEN 'node' WHEN osmr IS NOT NULL THEN 'relation' END AS kind,
  globe = '' AS earth FROM k)
SELECT qid, kind, coalesce(osmw, osmn, osmr) AS feature_id, CASE WHEN earth THEN lon END AS lon, CASE WHEN earth THEN lat END AS lat,
  CASE WHEN earth THEN CAST(least(greatest(floor((lon + 180) / 360 * 256), 0), 255) AS BIGINT) END AS x,
  CASE WHEN earth THEN CAST(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256), 0), 255) AS BIGINT) END AS y
FROM t""",
)
def mappable(spark, sf):
    statements = sql_over(spark, sf, GEO, "v_geo").withColumn(
        "coord",
        F.concat("globe", F.lit("Point("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")),
    )
    return J.mappable(statements).select(
        "qid", F.col("feature.kind").alias("kind"), F.col("feature.id").alias("feature_id"),
        F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat"), F.col("tile.x").alias("x"), F.col("tile.y").alias("y"),
    )


HITS = "SELECT value_id AS heading, count(*) AS total, bool_or(rank = 'preferred' AND property = 'P1') AS is_subject FROM v_claims GROUP BY value_id"


@query(
    "split_broad",
    f"""{with_views('v_claims')}, h AS ({HITS})
SELECT heading, total, is_subject, CASE WHEN total > 30 AND NOT is_subject THEN 'note' ELSE 'shelf' END AS route FROM h""",
)
def split_broad(spark, sf):
    shelves, notes = J.split_broad(sql_over(spark, sf, HITS, "v_claims"), above=30)
    return shelves.withColumn("route", F.lit("shelf")).unionByName(notes.withColumn("route", F.lit("note")))


WIDE = """SELECT qid, min(CASE WHEN property = 'P2' THEN value_id END) AS met, min(CASE WHEN property = 'P3' THEN value_id END) AS iiif,
  min(CASE WHEN property = 'P4' THEN value_id END) AS coord, min(CASE WHEN property = 'P5' THEN value_id END) AS osmw FROM v_claims GROUP BY qid"""


@query(
    "eligible_keys",
    f"""{with_views('v_claims')}, w AS ({WIDE})
SELECT qid, 'rights' AS need FROM w WHERE met IS NOT NULL OR iiif IS NOT NULL
UNION ALL SELECT qid, 'place' FROM w WHERE coord IS NOT NULL OR osmw IS NOT NULL
UNION ALL SELECT qid, 'artworks' FROM w WHERE EXISTS (SELECT 1 FROM v_claims c JOIN part ON p_partkey = value_id
  WHERE c.qid = w.qid AND property = 'P1' AND p_type = 'STANDARD')""",
)
def eligible_keys(spark, sf):
    statements = sql_over(spark, sf, WIDE, "v_claims")
    claims = view(spark, sf, "v_claims").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("value_id"), "p_type"), "value_id"
    ).select("qid", "property", F.col("p_type").alias("value_id"))
    out = None
    for need in ("rights", "place", "artworks"):
        keys = J.eligible_keys(statements, claims, need, person="STANDARD", class_property="P1").withColumn("need", F.lit(need))
        out = keys if out is None else out.unionByName(keys)
    return out


VARIABLES = {"P1": "met", "P2": "aic", "P3": "coord", "P4": "lc", "P5": "eu", "P6": "sicoll", "P7": "siinv"}
MUSEUMS = "SELECT p_partkey AS museum, p_name AS name FROM part WHERE p_type = 'PROMO'"


@query(
    "partner_statements",
    f"""{with_views('v_claims')}, m AS ({MUSEUMS}),
a AS (SELECT DISTINCT value_id AS qid FROM v_claims),
w AS (SELECT qid, {', '.join(f"min(value_id) FILTER (WHERE property = '{p}') AS {v}" for p, v in VARIABLES.items())},
  min(value_id) FILTER (WHERE property = 'P6' AND value_id IN (SELECT museum FROM m)) AS grp FROM v_claims WHERE qid IN (SELECT qid FROM a) GROUP BY qid)
SELECT qid, {', '.join(VARIABLES.values())}, CASE WHEN grp IS NOT NULL THEN siinv END AS si,
  CASE WHEN grp IS NOT NULL AND siinv IS NOT NULL THEN (SELECT name FROM m WHERE museum = grp) END AS si_name FROM w""",
)
def partner_statements(spark, sf):
    claims = view(spark, sf, "v_claims").withColumn("value", F.col("value_id"))
    anchors = claims.select(F.col("value_id").alias("qid")).distinct()
    registry = spark.createDataFrame(list(VARIABLES.items()), "property string, var string")
    return J.partner_statements(claims, anchors, registry, list(VARIABLES.values()), sql_over(spark, sf, MUSEUMS))


DOCS = """SELECT p_partkey AS doc_id, p_partkey AS ord, p_name AS title, p_partkey + 1 AS isbn1, p_partkey + 2 AS isbn2,
  CASE WHEN p_size < 20 THEN p_partkey + 3 END AS lccn, CASE WHEN p_size < 35 THEN p_partkey + 4 END AS oclc FROM part"""
ASKED = """SELECT page_id * 1000000 + section_ord * 1000 + ord AS cite_id, isbn, title,
  CASE WHEN isbn IS NULL AND has_url THEN doi END AS lccn, CASE WHEN isbn IS NULL THEN doi END AS oclc FROM v_cites"""


def _overlap(a: str, b: str) -> str:
    words = "list_distinct(string_split({}, ' '))"
    wanted, held = words.format(a), words.format(b)
    return f"CAST(len(list_intersect({wanted}, {held})) AS DOUBLE) / len({wanted})"


@query(
    "match_archive_docs",
    f"""{CITES}, d AS ({DOCS}), a AS ({ASKED}),
i AS (SELECT unnest([isbn1, isbn2]) AS isbn, doc_id, ord, title FROM d),
s AS (SELECT a.cite_id, i.doc_id, {_overlap('a.title', 'i.title')} AS score, i.ord FROM a JOIN i ON i.isbn = a.isbn),
b AS (SELECT *, row_number() OVER (PARTITION BY cite_id ORDER BY score DESC, ord) AS n FROM s WHERE score >= 0.34)
SELECT cite_id, doc_id, score, 'isbn' AS via, 'identifier' AS evidence FROM b WHERE n = 1
UNION ALL SELECT cite_id, min(doc_id), NULL, 'lccn', 'identifier-unverified' FROM a JOIN d ON d.lccn = a.lccn WHERE a.isbn IS NULL GROUP BY cite_id
UNION ALL SELECT cite_id, min(doc_id), NULL, 'oclc', 'identifier-unverified' FROM a JOIN d ON d.oclc = a.oclc
  WHERE a.isbn IS NULL AND a.lccn IS NULL GROUP BY cite_id""",
)
def match_archive_docs(spark, sf):
    docs = sql_over(spark, sf, DOCS).withColumn("isbns", F.array("isbn1", "isbn2"))
    hits = J.match_archive_docs(sql_over(spark, sf, ASKED, "v_cites"), docs)
    return hits.select("cite_id", "doc_id", "score", "via", "evidence")


VOLUMES = """SELECT p_partkey AS isbn, p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'borrow' WHEN 2 THEN 'catalog' END AS availability FROM part"""


@query(
    "citation_access",
    f"""{CITES}, v AS ({VOLUMES}), f AS (SELECT DISTINCT isbn FROM v_cites WHERE key_failed AND isbn IS NOT NULL)
SELECT page_id, section_ord, c.ord, c.isbn, availability AS access,
  c.isbn IS NOT NULL AND availability IS NULL AND f.isbn IS NOT NULL AS unchecked
FROM v_cites c LEFT JOIN v ON v.isbn = c.isbn LEFT JOIN f ON f.isbn = c.isbn""",
)
def citation_access(spark, sf):
    cites = view(spark, sf, "v_cites")
    volumes = sql_over(spark, sf, VOLUMES).filter("availability IS NOT NULL")
    failed = cites.filter("key_failed").select("isbn")
    return J.citation_access(cites.select("page_id", "section_ord", "ord", "isbn"), volumes, failed)


PAPERS = """SELECT page_id * 1000000 + section_ord * 1000 + ord AS paper_id, '10.1/' || CAST(doi AS STRING) AS doi,
  'https://doi.org/10.1/' || CAST(doi AS STRING) AS full_doi, CAST(isbn AS STRING) AS pmid,
  CASE WHEN cite_key IS NULL THEN concat('arx', CAST(ord AS STRING)) END AS arxiv FROM v_cites"""
CATALOGUE = """SELECT p_partkey AS work_id, p_partkey AS ord, CASE WHEN p_size <= 30 THEN concat('10.1/', CAST(p_partkey AS STRING)) END AS doi,
  CASE WHEN p_size > 20 THEN CAST(p_partkey + 1 AS STRING) END AS pmid, p_type <> 'PROMO' AS is_oa,
  CASE WHEN p_type <> 'ECONOMY' THEN concat('http://oa.example/', CAST(p_partkey AS STRING)) END AS oa_url,
  p_brand AS licence, p_type = 'PROMO' AND p_size % 2 = 0 AS is_retracted FROM part"""


@query(
    "match_papers",
    f"""{CITES}, p AS ({PAPERS}), w AS ({CATALOGUE}),
j AS (SELECT paper_id, w.*, 'doi' AS via FROM p JOIN w ON w.doi = p.doi WHERE p.arxiv IS NULL
  UNION ALL SELECT paper_id, w.*, 'pmid' FROM p JOIN w ON w.pmid = p.pmid WHERE p.arxiv IS NULL AND p.doi IS NULL)
SELECT paper_id, work_id, via, CASE WHEN is_oa AND oa_url IS NOT NULL THEN oa_url ELSE doi END AS href, licence,
  is_retracted AS retracted, NOT (is_oa AND oa_url IS NOT NULL) AS no_free_copy
FROM j WHERE (is_oa AND oa_url IS NOT NULL) OR (is_retracted AND doi IS NOT NULL)
UNION ALL SELECT paper_id, NULL, 'arxiv', concat('https://arxiv.org/abs/', arxiv), NULL, false, false FROM p WHERE arxiv IS NOT NULL""",
)
def match_papers(spark, sf):
    papers = sql_over(spark, sf, PAPERS, "v_cites").withColumn("doi", F.upper("full_doi"))
    papers = papers.withColumn("doi", F.regexp_replace("doi", "^HTTPS://DOI.ORG/", "https://doi.org/"))
    return J.match_papers(papers.drop("full_doi"), sql_over(spark, sf, CATALOGUE))


@query(
    "confirm_retractions",
    f"""{with_views('v_claims')},
w AS (SELECT qid, bool_or(rank <> 'normal') AS retracted FROM v_claims GROUP BY qid),
b AS (SELECT DISTINCT a.qid, a.value_id FROM v_claims a JOIN v_claims b ON b.qid = a.value_id AND b.value_id = a.qid WHERE a.rank <> 'deprecated')
SELECT concat('10.5/', CAST(w.qid AS STRING)) AS doi, retracted AND count(b.value_id) > 0 AS is_retracted,
  CASE WHEN retracted THEN min('10.5/' || CAST(b.value_id AS STRING)) END AS notice
FROM w LEFT JOIN b ON b.qid = w.qid GROUP BY w.qid, retracted""",
)
def confirm_retractions(spark, sf):
    def doi(c):
        return F.concat(F.lit("10.5/"), F.col(c).cast("string"))

    claims = view(spark, sf, "v_claims")
    works = claims.groupBy(doi("qid").alias("doi")).agg(F.bool_or(F.col("rank") != "normal").alias("is_retracted"))
    updated_by = claims.filter("rank <> 'deprecated'").select(
        doi("qid").alias("doi"), F.lit("retraction").alias("type"), F.lit("retraction-watch").alias("source"), doi("value_id").alias("notice")
    )
    update_to = claims.select(doi("qid").alias("notice"), F.lit("retraction").alias("type"), doi("value_id").alias("doi"))
    return J.confirm_retractions(works, updated_by, update_to)


FORMS = "SELECT partner AS heading_id, concat(partner, '/', title) AS form, min(editions * 1000000 + id) AS ord FROM v_holdings GROUP BY partner, title"


@query(
    "subject_heading_match",
    f"""{CITES}, v_holdings AS (SELECT p_partkey AS id, p_brand AS partner, p_name AS title, p_size AS editions FROM part), f AS ({FORMS})
SELECT heading_id, c.page_id * 1000 + c.section_ord AS record_id, arg_min(form, f.ord) AS form
FROM v_cites c JOIN f ON f.form = concat(c.source, '/', c.title) GROUP BY 1, 2""",
)
def subject_heading_match(spark, sf):
    records = view(spark, sf, "v_cites").groupBy(
        (F.col("page_id") * 1000 + F.col("section_ord")).alias("record_id")
    ).agg(F.collect_set(F.concat("source", F.lit("/"), "title")).alias("subjects"))
    return J.subject_heading_match(sql_over(spark, sf, FORMS, "v_holdings"), records)


@query(
    "topic_corroboration",
    """WITH r AS (SELECT p_brand, p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS st FROM part),
n AS (SELECT DISTINCT p_brand, p_partkey, string_split(p_name, ' ') AS nt FROM part WHERE p_size <= 40),
m AS (SELECT DISTINCT p_brand, st, nt FROM (SELECT DISTINCT p_brand, st FROM r) JOIN (SELECT DISTINCT p_brand, nt FROM n) USING (p_brand)
  WHERE list_has_all(st, nt)),
t AS (SELECT m.p_brand, st, min(p_partkey) AS lo, max(p_partkey) AS hi FROM m JOIN n ON n.p_brand = m.p_brand AND n.nt = m.nt GROUP BY 1, 2)
SELECT r.p_brand AS page_id, r.p_partkey AS record_id FROM r JOIN t ON t.p_brand = r.p_brand AND t.st = r.st WHERE lo <> r.p_partkey OR hi <> r.p_partkey""",
)
def topic_corroboration(spark, sf):
    part = table(spark, sf, "part")
    records = part.select(
        F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("own"),
        F.array(F.concat_ws(" ", "p_name", "p_type")).alias("subjects"),
    )
    topic = part.select(
        F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("qid"), F.initcap("p_name").alias("name"),
        (F.col("p_size") > 40).alias("place"),
    )
    return J.topic_corroboration(records, topic).select("page_id", "record_id")


CANDIDATES = """SELECT page_id AS subject, section_ord, ord, concat(split_part(title, ' ', 2), ', ', split_part(title, ' ', 1)) AS creator,
  concat('+', CAST(1990 + cite_key % 3 AS STRING), '-00-00T00:00:00Z') AS date, concat('The ', title, ' Museums') AS institution FROM v_cites"""
DESCRIBED = """SELECT p_partkey AS subject, concat(split_part(p_name, ' ', 1), ' X. ', split_part(p_name, ' ', 2)) AS person_name,
  concat('+', CAST(1990 + p_size % 3 AS STRING), '-05-01T00:00:00Z') AS year, concat('Museum of ', split_part(p_name, ' ', 2)) AS claimed FROM part"""


@query(
    "corroborate",
    f"""{CITES}, c AS (SELECT *, split_part(title, ' ', 1) AS a1, split_part(title, ' ', 2) AS n1, 1990 + cite_key % 3 AS y1 FROM v_cites),
d AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a2, split_part(p_name, ' ', 2) AS n2, 1990 + p_size % 3 AS y2 FROM part),
m AS (SELECT page_id AS subject, section_ord, ord, a1 = a2 AND n1 = n2 AS cr, coalesce(y1 = y2, false) AS da, n1 = n2 AS ins FROM c JOIN d ON p_partkey = page_id)
SELECT subject, section_ord, ord, concat_ws(',', CASE WHEN cr THEN 'creator' END, CASE WHEN da THEN 'date' END, CASE WHEN ins THEN 'institution' END) AS fields,
  cr AND da AND ins AS matched FROM m""",
)
def corroborate(spark, sf):
    out = J.corroborate(sql_over(spark, sf, CANDIDATES, "v_cites"), sql_over(spark, sf, DESCRIBED))
    return out.select("subject", "section_ord", "ord", F.array_join("corroborated_by", ",").alias("fields"), "matched")


THESIS_CLAIMS = """SELECT qid, CASE property WHEN 'P1' THEN 'P1026' WHEN 'P2' THEN 'P724' WHEN 'P3' THEN 'P577' WHEN 'P4' THEN 'P4101' END AS property, ord,
  CASE WHEN property = 'P3' THEN concat('+', CAST(1990 + value_id % 2 AS STRING), '-00-00T00:00:00Z') ELSE CAST(value_id AS STRING) END AS value, value_id
FROM v_claims WHERE property IN ('P1', 'P2', 'P3', 'P4')"""
THESIS_DOCS = """SELECT CAST(p_partkey AS STRING) AS identifier, p_partkey AS ord, CASE WHEN p_size > 25 THEN p_name END AS title,
  concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1)) AS creator, CAST(1990 + p_size % 2 AS STRING) AS date, concat(p_type, ' university') AS institution FROM part"""
PERSONS = "SELECT o_orderkey AS qid, p_name AS name FROM orders JOIN part ON p_partkey = o_custkey"
UNIVERSITIES = "SELECT CAST(p_partkey AS STRING) AS qid, concat('University ', p_type) AS label FROM part"


@query(
    "thesis_holding",
    f"""{with_views('v_claims')}, c AS ({THESIS_CLAIMS}), d AS ({THESIS_DOCS}),
f AS (SELECT qid, property, arg_min(value, ord) AS v, arg_min(value_id, ord) AS vid FROM c GROUP BY 1, 2),
t AS (SELECT a.qid AS subject, a.v AS thesis, s.v AS stated, y.v AS yr, u.vid AS uni FROM f a LEFT JOIN f s ON CAST(s.qid AS VARCHAR) = a.v AND s.property = 'P724'
  LEFT JOIN f y ON CAST(y.qid AS VARCHAR) = a.v AND y.property = 'P577' LEFT JOIN f u ON CAST(u.qid AS VARCHAR) = a.v AND u.property = 'P4101' WHERE a.property = 'P1026'),
k AS (SELECT subject, thesis, identifier FROM t JOIN d ON d.identifier = t.stated AND d.title IS NOT NULL),
x AS (SELECT subject, thesis, arg_min(identifier, d.ord) AS identifier FROM t JOIN ({PERSONS}) p ON p.qid = t.subject JOIN part u ON u.p_partkey = t.uni
  JOIN part dp ON dp.p_name = p.name AND dp.p_type = u.p_type AND 1990 + dp.p_size % 2 = CAST(substr(t.yr, 2, 4) AS INT)
  JOIN d ON d.identifier = CAST(dp.p_partkey AS VARCHAR) WHERE t.subject NOT IN (SELECT subject FROM k) GROUP BY 1, 2)
SELECT subject, thesis, identifier, 'identifier' AS evidence, '' AS fields FROM k
UNION ALL SELECT subject, thesis, identifier, 'corroborated', 'creator,date,institution' FROM x""",
)
def thesis_holding(spark, sf):
    claims = sql_over(spark, sf, THESIS_CLAIMS, "v_claims").withColumn("qid", F.col("qid").cast("string"))
    persons = sql_over(spark, sf, PERSONS).withColumn("qid", F.col("qid").cast("string"))
    out = J.thesis_holding(claims, sql_over(spark, sf, THESIS_DOCS), persons, sql_over(spark, sf, UNIVERSITIES))
    return out.select(
        F.col("subject").cast("bigint").alias("subject"), "thesis", "identifier", "evidence",
        F.array_join("corroborated_by", ",").alias("fields"),
    )


INVENTORY = """SELECT p_partkey AS qid, p_type AS museum, concat(CASE WHEN p_size % 3 = 0 THEN 'EN' WHEN p_size % 3 = 1 THEN 'fr' ELSE 'es' END, '/', CAST(p_partkey AS STRING)) AS inventory FROM part"""


@query(
    "inventory_match",
    f"""{with_views('v_pages')}, i AS ({INVENTORY})
SELECT qid, inventory, min(page_id) AS record_id FROM i JOIN v_pages
  ON ends_with(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), regexp_replace(lower(inventory), '[^a-z0-9]', '', 'g'))
WHERE museum <> 'ECONOMY' GROUP BY 1, 2""",
)
def inventory_match(spark, sf):
    records = view(spark, sf, "v_pages").select(F.col("page_id").alias("record_id"), F.col("page_id").alias("ord"), "url")
    registry = table(spark, sf, "part").filter("p_type <> 'ECONOMY'").select(F.col("p_type").alias("museum")).distinct()
    return J.inventory_match(sql_over(spark, sf, INVENTORY), records, registry)


TAXA = "SELECT DISTINCT p_brand AS qid, concat('  ', upper(p_name), ' ') AS name FROM part"
SPECIMENS = """SELECT p_partkey AS record_id, p_partkey AS ord, p_name AS name, CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END AS models,
  CASE WHEN p_type = 'PROMO' THEN concat(p_name, ': skull') WHEN p_type = 'SMALL' THEN concat(p_name, ': left wing') ELSE p_name END AS scan_subject,
  p_size > 45 AS truncated FROM part"""


@query(
    "taxon_match",
    f"""WITH s AS (SELECT record_id, name, truncated, CASE WHEN scan_subject LIKE '%: skull' THEN 1 WHEN scan_subject LIKE '%:%' THEN 2 ELSE 0 END AS scan_rank FROM ({SPECIMENS}) WHERE models > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scan_rank, record_id) AS place, count(*) OVER (PARTITION BY name) AS total,
  bool_or(truncated) OVER (PARTITION BY name) AS cut FROM s)
SELECT DISTINCT p_brand AS qid, record_id, CAST(scan_rank AS BIGINT) AS scan_rank, place, total, cut AS truncated FROM part JOIN r ON name = p_name WHERE place <= 3""",
)
def taxon_match(spark, sf):
    records = sql_over(spark, sf, SPECIMENS).withColumn("names", F.array(F.initcap("name"), F.lit("other name")))
    return J.taxon_match(sql_over(spark, sf, TAXA), records, 3)


# Numbers have six places: what a longer key has behind them is its series. Stated links are unique.
SERIES = "substr(CAST(o_orderkey AS STRING), 7)"
OBJECTS = f"""SELECT concat('200', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS object_id,
  CASE WHEN o_orderstatus = 'F' THEN concat('999', CAST(o_custkey AS STRING)) END AS visual_id,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE {SERIES} END AS series FROM orders"""
VISUALS = f"""SELECT concat('202', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS visual_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS STRING) END AS digital_id, o_orderpriority AS rights, {SERIES} AS series FROM orders
UNION ALL SELECT concat('999', CAST(c_custkey AS STRING)), CAST(c_custkey AS STRING), c_mktsegment, '' FROM customer"""
DIGITALS = "SELECT CAST(c_custkey AS STRING) AS digital_id, n_name AS access_point FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0"


@query(
    "linked_object_chain",
    f"""WITH d AS ({DIGITALS})
SELECT concat('200', lpad(CAST(o_orderkey AS VARCHAR), 6, '0')) AS object_id,
  CASE WHEN o_orderstatus = 'F' THEN concat('999', CAST(o_custkey AS VARCHAR)) ELSE concat('202', lpad(CAST(o_orderkey AS VARCHAR), 6, '0')) END AS visual_id,
  CASE WHEN o_orderstatus = 'F' OR o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS VARCHAR) END AS digital_id,
  CASE WHEN o_orderstatus = 'F' THEN c_mktsegment ELSE o_orderpriority END AS rights,
  CASE WHEN o_orderstatus = 'F' OR o_orderpriority <> '5-LOW' THEN access_point END AS access_point
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN d ON d.digital_id = CAST(o_custkey AS VARCHAR)""",
)
def linked_object_chain(spark, sf):
    return J.linked_object_chain(sql_over(spark, sf, OBJECTS), sql_over(spark, sf, VISUALS), sql_over(spark, sf, DIGITALS), within=["series"])


REGISTRY = [("a", "P1", 1, 0), ("b", "P2", 2, 1), ("c", "P3", 3, 2), ("d", "P5", None, 3)]
REGISTRY_DDL = "partner string, property string, collection bigint, ord int"
REGISTRY_SQL = "reg(partner, property, collection, o) AS (VALUES ('a', 'P1', 1, 0), ('b', 'P2', 2, 1), ('c', 'P3', 3, 2), ('d', 'P5', NULL, 3))"
HOLDER_CLAIMS = "SELECT qid, property, rank, ord, CASE WHEN property = 'P4' THEN value_id % 5 ELSE value_id END AS value_id FROM v_claims"
HOLDER_SQL = f"""hc AS ({HOLDER_CLAIMS}), {REGISTRY_SQL},
best AS (SELECT * FROM (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY qid, property) AS p FROM hc) WHERE rank = 'preferred' OR (rank = 'normal' AND NOT p)),
ids AS (SELECT qid, partner, best.property, collection, o, arg_min(value_id, ord) AS id FROM best JOIN reg ON reg.property = best.property GROUP BY ALL),
pick AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (SELECT count(*) = 0 FROM best b WHERE b.qid = ids.qid AND b.property = 'P4' AND b.value_id = ids.collection), o) AS n FROM ids)"""


def registry(spark):
    return spark.createDataFrame(REGISTRY, REGISTRY_DDL)


@query(
    "select_holder",
    f"""{with_views('v_claims')}, {HOLDER_SQL} SELECT qid, partner, property, id FROM pick WHERE n = 1""",
)
def select_holder(spark, sf):
    parts = parts_of(spark, sf, "lineitem")
    claims = sql_over(spark, sf, HOLDER_CLAIMS, "v_claims", dealt={"lineitem": "l_orderkey"}, parts=parts)
    return J.select_holder(claims, registry(spark), "P4", parts)


@query(
    "partner_host_match",
    f"""{with_views('v_pages')}, b AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS base FROM v_pages)
SELECT DISTINCT host, base, concat('partner of ', base) AS slug FROM v_pages JOIN b ON host = base OR ends_with(host, concat('.', base))""",
)
def partner_host_match(spark, sf):
    hosts = view(spark, sf, "v_pages").select("host").distinct()
    base = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    partners = hosts.select(base.alias("base")).distinct().withColumn("slug", F.concat(F.lit("partner of "), "base"))
    return J.partner_host_match(hosts, partners)


SCANNED = "SELECT p_partkey AS work_key, concat('The ', p_name) AS title, CASE WHEN p_size % 3 > 0 THEN p_partkey + 1 END AS scan_id FROM part"
SCANS = """SELECT p_partkey AS scan_id, concat(split_part(p_name, ' ', 1), CASE WHEN p_size > 25 THEN ' ' ELSE '; ' END, split_part(p_name, ' ', 2), ', 1901') AS scan_title,
  CASE WHEN p_type = 'SMALL' THEN p_partkey - 1 END AS scan_work FROM part WHERE p_brand <> 'Brand#1'"""


@query(
    "verify_scans",
    f"""WITH w AS ({SCANNED}), s AS ({SCANS}),
j AS (SELECT w.*, s.scan_title, s.scan_work, s.scan_id IS NOT NULL AS seen, lower(title) AS wt,
  trim(regexp_replace(lower(coalesce(scan_title, '')), '[^a-z0-9]+', ' ', 'g')) AS st,
  trim(regexp_replace(regexp_replace(regexp_extract(lower(coalesce(scan_title, '')), '^[^;:/]*', 0), '[, ]*[0-9]{{4}}$', ''), '[^a-z0-9]+', ' ', 'g')) AS ct
  FROM w LEFT JOIN s ON s.scan_id = w.scan_id),
o AS (SELECT *, CASE WHEN seen THEN coalesce(scan_work = work_key, false) OR contains(wt, st) OR contains(st, wt) END AS owned FROM j)
SELECT work_key, owned, coalesce(owned, false) AND ct <> '' AND NOT contains(ct, wt) AND NOT contains(wt, ct) AS alien FROM o""",
)
def verify_scans(spark, sf):
    out = J.verify_scans(sql_over(spark, sf, SCANNED), sql_over(spark, sf, SCANS))
    return out.select("work_key", "owned", "alien")


PANEL_ROWS = """SELECT l_partkey AS page_id, l_orderkey * 100 + l_linenumber * 10 + l_suppkey AS ord,
  CASE l_linenumber WHEN 1 THEN 'Artist' WHEN 2 THEN ' Year' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Type' WHEN 5 THEN 'Location' WHEN 6 THEN 'Accession' ELSE 'Dimensions' END AS label,
  CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN upper(p_brand) WHEN l_linenumber IN (3, 4) AND l_quantity > 15 THEN p_type
    WHEN l_linenumber = 2 AND l_quantity > 35 THEN concat(' ', CAST(p_size AS STRING)) ELSE concat('no ', CAST(l_suppkey AS STRING)) END AS value
FROM lineitem JOIN part ON p_partkey = l_partkey"""
PANEL_HOLDINGS = """SELECT p_partkey AS page_id, p_brand AS creator, CAST(p_size AS STRING) AS date, p_type AS medium, CASE WHEN p_size > 20 THEN '10 cm' ELSE '' END AS dimensions,
  CAST(NULL AS STRING) AS accession, concat('Gift ', CAST(p_size AS STRING)) AS credit FROM part"""


@query(
    "panel_compare",
    f"""WITH r AS (SELECT *, trim(lower(label)) AS l, trim(lower(value)) AS v FROM ({PANEL_ROWS})), h AS ({PANEL_HOLDINGS}),
m AS (SELECT DISTINCT page_id FROM r WHERE l = 'medium'),
f AS (SELECT r.*, CASE WHEN l = 'artist' THEN 'creator' WHEN l = 'year' THEN 'date' WHEN l = 'medium' THEN 'medium' WHEN l = 'dimensions' THEN 'dimensions'
  WHEN l = 'accession' THEN 'accession' WHEN l = 'type' AND m.page_id IS NULL THEN 'medium' END AS field FROM r LEFT JOIN m ON m.page_id = r.page_id),
n AS (SELECT *, CASE WHEN field IS NOT NULL THEN row_number() OVER (PARTITION BY page_id, field ORDER BY ord, label, value) END AS k FROM f),
hv AS (UNPIVOT (SELECT page_id, creator, date, medium, nullif(dimensions, '') AS dimensions, accession, credit FROM h) ON creator, date, medium, dimensions, accession, credit INTO NAME field VALUE holder),
a AS (SELECT n.page_id, n.ord, CASE WHEN k = 1 THEN n.field END AS field, hv.holder, n.v FROM n LEFT JOIN hv ON hv.page_id = n.page_id AND hv.field = n.field AND k = 1)
SELECT page_id, field, ord, CASE WHEN holder IS NULL THEN 'article-only' WHEN v = lower(holder) THEN 'agree' ELSE 'conflict' END AS status FROM a
UNION ALL SELECT page_id, field, NULL, 'holder-only' FROM hv WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page_id = hv.page_id AND n.field = hv.field)""",
)
def panel_compare(spark, sf):
    facts = J.panel_compare(sql_over(spark, sf, PANEL_ROWS), sql_over(spark, sf, PANEL_HOLDINGS))
    return facts.select("page_id", "field", "ord", "status")


ITEMS = "SELECT p_partkey AS item_id, p_name AS title, concat('File:', CAST(p_partkey AS STRING)) AS file_title, CASE WHEN p_size % 2 = 0 THEN concat('t', CAST(p_partkey AS STRING)) END AS thumbnail, CASE WHEN p_type = 'PROMO' THEN 'openstreetmap' ELSE p_brand END AS source FROM part"
LEADS = "SELECT p_name AS title, concat('lead of ', p_name) AS source_url, 200.0D AS width, 100.0D + max(p_size) AS height, concat('File:', CAST(max(p_partkey) AS STRING)) AS lead_file FROM part WHERE p_name LIKE 'red%' GROUP BY p_name"
FILES = "SELECT concat('File:', CAST(p_partkey AS STRING)) AS file_title, CASE WHEN p_size > 15 THEN concat('u', CAST(p_partkey AS STRING)) END AS thumb_url, 100.0D AS width, 50.0D AS height, p_brand AS credit FROM part WHERE p_size > 10"


@query(
    "pick_picture",
    f"""WITH i AS ({ITEMS}), l AS ({LEADS.replace('0D', '0')}), f AS ({FILES.replace('0D', '0')})
SELECT item_id, CASE WHEN source_url IS NOT NULL THEN source_url WHEN f.thumb_url IS NOT NULL THEN f.thumb_url ELSE thumbnail END AS url,
  CASE WHEN source_url IS NOT NULL THEN CAST(l.height / l.width AS DOUBLE) WHEN f.thumb_url IS NOT NULL THEN CAST(f.height / f.width AS DOUBLE) END AS aspect,
  CASE WHEN source_url IS NOT NULL THEN lf.credit WHEN f.thumb_url IS NOT NULL THEN f.credit WHEN thumbnail IS NOT NULL AND source = 'openstreetmap' THEN '© OpenStreetMap contributors' END AS credit,
  CASE WHEN source_url IS NOT NULL THEN 'lead' WHEN f.thumb_url IS NOT NULL THEN 'file' WHEN thumbnail IS NOT NULL THEN 'stated' END AS route
FROM i LEFT JOIN l ON l.title = i.title LEFT JOIN f lf ON lf.file_title = l.lead_file LEFT JOIN f ON f.file_title = i.file_title""",
)
def pick_picture(spark, sf):
    out, _ = J.pick_picture(sql_over(spark, sf, ITEMS), sql_over(spark, sf, LEADS), sql_over(spark, sf, FILES))
    return out


RAIL = """SELECT page_id, section_ord, isbn, CASE WHEN has_url THEN 'https://archive.org/details/' || CAST(cite_key % 50 AS STRING) END AS href FROM v_cites WHERE has_image"""
RAIL_HITS = """SELECT page_id, section_ord, ord, isbn, CASE WHEN volume IS NOT NULL THEN concat('https://archive.org/services/img/', CAST(cite_key % 50 AS STRING)) END AS image_url FROM v_cites WHERE cite_key IS NOT NULL"""


@query(
    "dedupe_against_rail",
    f"""{CITES}, r AS ({RAIL}), h AS (SELECT *, regexp_extract(image_url, '/img/([0-9]+)', 1) AS scan FROM ({RAIL_HITS})),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = h.page_id AND r.section_ord = h.section_ord AND r.isbn = h.isbn)
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = h.page_id AND r.section_ord = h.section_ord AND r.href = 'https://archive.org/details/' || h.scan)),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, section_ord, scan ORDER BY ord) AS k FROM k)
SELECT page_id, section_ord, ord, scan AS scan_id FROM n WHERE scan IS NULL OR k = 1""",
)
def dedupe_against_rail(spark, sf):
    hits = J.dedupe_against_rail(sql_over(spark, sf, RAIL_HITS, "v_cites"), sql_over(spark, sf, RAIL, "v_cites"))
    return hits.select("page_id", "section_ord", "ord", "scan_id")


LABELS = "SELECT o_orderkey AS qid, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS STRING) ELSE concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING)) END AS label FROM orders"
SITELINKS = "SELECT o_orderkey AS qid, concat('Article ', CAST(o_orderkey AS STRING)) AS title FROM orders WHERE o_totalprice > 200000"
WORK_MUSEUMS = {"met": "P2", "rijks": "P3", "aic": "P4", "iiif": "P5"}
WORKS_SQL = f"""lab AS ({LABELS}), sl AS ({SITELINKS}), made AS (SELECT DISTINCT value_id AS subject, qid AS work FROM v_claims WHERE property = 'P1'),
ids AS (SELECT qid AS work, {', '.join(f"min(value_id) FILTER (WHERE property = '{p}') AS {v}" for v, p in WORK_MUSEUMS.items())}
  FROM v_claims WHERE property IN ('P2', 'P3', 'P4', 'P5') GROUP BY qid),
works AS (SELECT subject, made.work, met, rijks, aic, iiif, label, sl.qid IS NOT NULL AS sitelink FROM made JOIN ids ON ids.work = made.work
  JOIN lab ON lab.qid = made.work AND label <> CAST(lab.qid AS VARCHAR) LEFT JOIN sl ON sl.qid = made.work)"""


def works_of_subjects(spark, sf):
    return J.subject_works(
        view(spark, sf, "v_claims"), sql_over(spark, sf, LABELS), sql_over(spark, sf, SITELINKS), WORK_MUSEUMS, "P1"
    )


query("subject_works", f"{with_views('v_claims')}, {WORKS_SQL} SELECT * FROM works")(works_of_subjects)


@query(
    "artwork_totals",
    f"""{with_views('v_claims')}, {WORKS_SQL}
SELECT subject, count(met) AS met, count(rijks) AS rijks, count(aic) AS aic, count(iiif) AS iiif, count(*) AS works FROM works GROUP BY subject""",
)
def artwork_totals(spark, sf):
    return M.artwork_totals(works_of_subjects(spark, sf), list(WORK_MUSEUMS))


WORK_CLASSES = "SELECT p_partkey AS class FROM part WHERE p_size <= 10"
CENSUS_CLAIMS = "SELECT qid, CASE property WHEN 'P6' THEN 'P31' ELSE property END AS property, rank, ord, value_id FROM v_claims"
CENSUS_SQL = f"""cls AS ({WORK_CLASSES}), sl AS ({SITELINKS}), {HOLDER_SQL},
kinds AS (SELECT DISTINCT qid FROM best WHERE property = 'P6' AND value_id IN (SELECT class FROM cls)),
rows AS (SELECT DISTINCT b.qid, b.property, b.value_id AS id, sl.title FROM best b JOIN reg ON reg.property = b.property JOIN sl ON sl.qid = b.qid WHERE b.qid IN (SELECT qid FROM kinds))"""


def census(spark, sf):
    parts = parts_of(spark, sf, "lineitem")
    claims = sql_over(spark, sf, HOLDER_CLAIMS, "v_claims", dealt={"lineitem": "l_orderkey"}, parts=parts).withColumn(
        "property", F.when(F.col("property") == "P6", "P31").otherwise(F.col("property"))
    )
    return J.holder_census(
        claims, sql_over(spark, sf, SITELINKS), sql_over(spark, sf, WORK_CLASSES), registry(spark), "P31", "P4", parts
    )


@query(
    "holder_census",
    f"""{with_views('v_claims')}, {CENSUS_SQL}
SELECT qid, property, id, title, (SELECT count(DISTINCT value_id) FROM best c WHERE c.qid = rows.qid AND c.property = 'P4') AS collections FROM rows""",
)
def holder_census(spark, sf):
    return census(spark, sf)[0]


@query(
    "holder_census_per_holder",
    f"""{with_views('v_claims')}, {CENSUS_SQL}
SELECT partner, count(*) AS items FROM pick WHERE n = 1 AND qid IN (SELECT qid FROM rows) GROUP BY partner""",
)
def holder_census_per_holder(spark, sf):
    return census(spark, sf)[1]


CONTROL_CLASSES = "SELECT p_partkey AS class FROM part WHERE p_size = 7"


@query(
    "subclass_control",
    f"""{with_views('v_claims', 'v_class').replace('WITH', 'WITH RECURSIVE', 1)}, cls AS ({CONTROL_CLASSES}), sl AS ({SITELINKS}), {HOLDER_SQL},
up AS (SELECT child AS class, parent AS super FROM v_class UNION SELECT up.class, v.parent FROM up JOIN v_class v ON v.child = up.super),
kind AS (SELECT qid, value_id AS class FROM best WHERE property = 'P6')
SELECT count(DISTINCT qid) AS n FROM kind WHERE class IN (SELECT class FROM up WHERE super IN (SELECT class FROM cls) AND super <> class)
  AND qid NOT IN (SELECT qid FROM kind WHERE class IN (SELECT class FROM cls)) AND qid IN (SELECT qid FROM sl)
  AND qid IN (SELECT qid FROM best JOIN reg ON reg.property = best.property)""",
)
def subclass_control(spark, sf):
    claims = sql_over(spark, sf, HOLDER_CLAIMS, "v_claims").withColumn(
        "property", F.when(F.col("property") == "P6", "P31").otherwise(F.col("property"))
    )
    return J.subclass_control(
        claims, view(spark, sf, "v_class"), sql_over(spark, sf, CONTROL_CLASSES), registry(spark), sql_over(spark, sf, SITELINKS)
    )


ENDED = "SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000"
LOCATABLE = "SELECT p_partkey AS class FROM part WHERE p_size = 50"
HISTORICAL = "SELECT p_partkey AS class FROM part WHERE p_size = 49"


@query(
    "class_verdicts",
    f"""{with_views('v_claims', 'v_class').replace('WITH', 'WITH RECURSIVE', 1)}, loc AS ({LOCATABLE}), his AS ({HISTORICAL}), en AS ({ENDED}),
up AS (SELECT DISTINCT value_id AS class, value_id AS super FROM v_claims UNION SELECT up.class, v.parent FROM up JOIN v_class v ON v.child = up.super),
ver AS (SELECT class, bool_or(super IN (SELECT class FROM loc)) AS place, bool_or(super IN (SELECT class FROM his)) AS past FROM up GROUP BY class)
SELECT qid AS item, bool_or(place) AS place, bool_or(past) OR qid IN (SELECT item FROM en) AS defunct FROM v_claims JOIN ver ON class = value_id GROUP BY qid""",
)
def class_verdicts(spark, sf):
    item_classes = view(spark, sf, "v_claims").select(F.col("qid").alias("item"), F.col("value_id").alias("class"))
    return R.class_verdicts(
        view(spark, sf, "v_class"), item_classes, sql_over(spark, sf, ENDED), sql_over(spark, sf, LOCATABLE), sql_over(spark, sf, HISTORICAL)
    )


@query(
    "lookup_batches",
    """WITH k AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS key FROM lineitem UNION SELECT DISTINCT p_brand FROM part),
r AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 40 AS batch FROM k)
SELECT batch, string_agg(key, ',' ORDER BY key) AS keys, count(*) AS size FROM r GROUP BY batch""",
)
def lookup_batches_query(spark, sf):
    keys = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("key")).unionByName(
        table(spark, sf, "part").select(F.col("p_brand").alias("key"))
    )
    return lookup_batches(keys, "key", 40).select(
        "batch", F.array_join("keys", ",").alias("keys"), F.size("keys").cast("bigint").alias("size")
    )
