"""Coverage, tallies, censuses and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.identifiers import host_of
from marginalia.operators import measure as M
from marginalia.operators import rights as R
from marginalia.plans.catalog import query
from marginalia.plans.views import parts_of, sql_over, table, view, with_views
from marginalia.sources.pages import store_by_page

# Cites with the answer of the volume lookup, as the coverage counts read it.
ACCESS = """SELECT page_id, section_ord, ord, source, cite_key, title, has_image, licensed,
  CASE WHEN isbn IS NOT NULL AND NOT key_failed THEN volume END AS access,
  isbn IS NOT NULL AND key_failed AS unchecked,
  has_url OR doi IS NOT NULL AS has_link, doi, isbn FROM v_cites"""

COVERAGE_SQL = f"""
SELECT page_id, section_ord, count(*) AS total,
  count(*) FILTER (WHERE access IN ('full', 'borrow')) AS open,
  count(*) FILTER (WHERE access = 'catalog') AS cataloged,
  count(*) FILTER (WHERE access IS NULL AND NOT unchecked AND has_link) AS linked,
  count(*) FILTER (WHERE unchecked) AS unchecked, true AS searched
FROM ({ACCESS}) GROUP BY page_id, section_ord"""


def access(spark, sf):
    return sql_over(spark, sf, ACCESS, "v_cites")


def with_access(cites):
    """The same over cites that are at hand."""
    return cites.sparkSession.sql(ACCESS.replace("v_cites", "{cites}"), cites=cites)


def coverage(spark, sf):
    return M.citation_coverage(access(spark, sf))


query("citation_coverage", f"{with_views('v_cites')} {COVERAGE_SQL}")(coverage)


@query(
    "page_coverage",
    f"""{with_views('v_cites')}, cov AS ({COVERAGE_SQL}),
pap AS (SELECT page_id, section_ord, count(doi) AS papers_total,
  count(doi) FILTER (WHERE licensed) AS papers_open FROM v_cites GROUP BY page_id, section_ord)
SELECT r_name, n_name, page_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(open) AS BIGINT) AS open,
  CAST(sum(cataloged) AS BIGINT) AS cataloged, CAST(sum(linked) AS BIGINT) AS linked,
  CAST(sum(unchecked) AS BIGINT) AS unchecked, CAST(sum(papers_total) AS BIGINT) AS papers_total,
  CAST(sum(papers_open) AS BIGINT) AS papers_open, bool_or(searched) AS searched,
  CAST(3 - grouping(r_name) - grouping(n_name) - grouping(page_id) AS BIGINT) AS depth
FROM cov JOIN pap USING (page_id, section_ord) JOIN customer ON c_custkey = page_id
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name, page_id)""",
)
def page_coverage(spark, sf):
    papers = access(spark, sf).groupBy("page_id", "section_ord").agg(
        F.count("doi").alias("papers_total"),
        F.count_if(F.col("doi").isNotNull() & F.col("licensed")).alias("papers_open"),
    )
    places = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("c_custkey").alias("page_id"), "r_name", "n_name")
    )
    return M.page_coverage(
        coverage(spark, sf).join(places, "page_id"), papers, ["r_name", "n_name", "page_id"]
    )


# A partner per brand, with a base host of its own.
PARTNERS = """SELECT DISTINCT p_brand AS slug, concat(lower(replace(p_brand, '#', '-')), '.example.org') AS base FROM part"""
NOTES = """SELECT page_id, concat('https://', CASE WHEN licensed THEN 'www.' ELSE 'm.' END,
  lower(replace(source, '#', '-')), '.example.org/item/', CAST(cite_key AS STRING)) AS access_url
FROM v_cites WHERE has_url AND cite_key IS NOT NULL"""

TALLY_SQL = """SELECT page_id, source AS slug, count(*) AS cards,
  count(*) FILTER (WHERE has_url AND cite_key IS NOT NULL AND source <> 'Brand#3') AS notes
FROM v_cites GROUP BY page_id, source"""


def tally(spark, sf):
    parts = parts_of(spark, sf, "lineitem")
    by_rows = {"dealt": {"orders": "o_orderkey", "part": "p_partkey"}, "parts": parts}
    cards = sql_over(spark, sf, "SELECT page_id, source FROM v_cites", "v_cites", **by_rows)
    notes = sql_over(spark, sf, NOTES, "v_cites", **by_rows)
    return M.partner_tally(cards, notes, sql_over(spark, sf, PARTNERS), left_out=("Brand#3",), parts=parts)


query("partner_tally", f"{with_views('v_cites')} {TALLY_SQL}")(tally)

def page_cites(spark, sf):
    """The cites of all pages, dealt by page once."""
    return store_by_page(view(spark, sf, "v_cites"), "cites")


@query(
    "stored_page_profile",
    f"""{with_views('v_cites')}, t AS ({TALLY_SQL}), c AS ({COVERAGE_SQL})
SELECT page_id, (SELECT count(*) FROM t WHERE t.page_id = c.page_id) AS partners, sum(total)::BIGINT AS total, sum(open)::BIGINT AS open,
  (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM v_cites v WHERE v.page_id = c.page_id AND cite_key IS NOT NULL GROUP BY cite_key HAVING count(*) > 1)) AS repeated
FROM c GROUP BY page_id""",
)
def stored_page_profile(spark, sf):
    """Per page its partners, its coverage and how many cites repeat a work: three groupings and two joins over one stored table."""
    cites = page_cites(spark, sf)
    partners = cites.groupBy("page_id").agg(F.countDistinct("source").alias("partners"))
    covered = M.citation_coverage(with_access(cites)).groupBy("page_id").agg(F.sum("total").alias("total"), F.sum("open").alias("open"))
    works = cites.filter("cite_key IS NOT NULL").groupBy("page_id", "cite_key").agg(F.count("*").alias("n")).filter("n > 1")
    again = works.groupBy("page_id").agg(F.sum("n").alias("repeated"))
    return covered.join(partners, "page_id").join(again, "page_id", "left").select("page_id", "partners", "total", "open", "repeated")


HOSTS = """SELECT DISTINCT p_brand AS slug, CASE CAST(substr(p_brand, 7) AS INT) % 4
  WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' WHEN 2 THEN 'example.org' ELSE 'elsewhere.test' END AS base
FROM part"""

# Hosts that one page's cards alone point at: the partner's own, that of the page, or one the page does not link.
CARD_HOSTS = """SELECT page_id, concat('Brand#', CAST(page_id % 25 + 1 AS STRING)) AS slug,
  CASE WHEN page_id % 3 = 0 THEN 'not-linked.test' ELSE replace(replace(lower(host), 'www.', ''), 'm.', '') END AS base FROM v_pages WHERE page_id % 5 < 3"""

VISIBILITY_SQL = f"""tally AS ({TALLY_SQL}), hosts AS ({HOSTS}),
reach AS (SELECT page_id, regexp_replace(lower(host), '^www\\.', '') AS host,
  page_id % 2 = 0 AS kartographer, page_id % 3 = 0 AS identifier_bar FROM v_pages),
linked AS (SELECT DISTINCT page_id, slug FROM reach JOIN hosts
  ON reach.host = hosts.base OR ends_with(reach.host, concat('.', hosts.base))
  UNION SELECT page_id, slug FROM reach JOIN (SELECT page_id, slug, base FROM ({CARD_HOSTS})) USING (page_id) WHERE reach.host = base OR ends_with(reach.host, concat('.', base))),
rows AS (SELECT t.page_id, t.slug, t.cards, t.notes,
  CASE WHEN t.slug = 'Brand#4' AND r.kartographer THEN 'shown'
    WHEN l.slug IS NOT NULL THEN 'link' ELSE 'invisible' END AS tier, r.identifier_bar
  FROM tally t LEFT JOIN linked l ON l.page_id = t.page_id AND l.slug = t.slug
  LEFT JOIN reach r ON r.page_id = t.page_id),
report AS (SELECT page_id, slug, cards, notes, tier,
  CASE WHEN tier = 'shown' THEN 'map' WHEN tier = 'invisible' THEN NULL WHEN slug = 'Brand#1' THEN 'doi'
    WHEN identifier_bar AND slug IN ('Brand#5', 'Brand#9') THEN 'identifier-bar' ELSE 'small-print' END AS place_of_link,
  row_number() OVER (PARTITION BY page_id ORDER BY CASE tier WHEN 'shown' THEN 0 WHEN 'link' THEN 1 ELSE 2 END,
    cards + notes DESC, slug) AS place
  FROM rows)"""


def visibility(spark, sf):
    pages = view(spark, sf, "v_pages").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        (F.col("page_id") % 2 == 0).alias("kartographer"),
        (F.col("page_id") % 3 == 0).alias("identifier_bar"),
    )
    general = sql_over(spark, sf, HOSTS).withColumn("page_id", F.lit(None).cast("bigint"))
    hosts = general.unionByName(sql_over(spark, sf, CARD_HOSTS, "v_pages"))
    return M.visibility_report(
        tally(spark, sf), pages, hosts,
        map_partner="Brand#4", bar_partners=("Brand#5", "Brand#9"), doi_partner="Brand#1",
    )


query(
    "visibility_report",
    f"{with_views('v_cites', 'v_pages')}, {VISIBILITY_SQL} SELECT * FROM report",
)(visibility)


@query(
    "gap_counts",
    f"""{with_views('v_cites', 'v_pages')}, {VISIBILITY_SQL}
SELECT page_id, count(*) AS total, count(*) FILTER (WHERE tier = 'shown') AS shown,
  count(*) FILTER (WHERE tier = 'link') AS link, count(*) FILTER (WHERE tier = 'invisible') AS invisible
FROM report GROUP BY page_id""",
)
def gap_counts(spark, sf):
    return M.gap_counts(visibility(spark, sf))


@query(
    "sources_and_evidence",
    f"""{with_views('v_cites')}
SELECT page_id, string_agg(DISTINCT lpad(substr(source, 7), 2, '0'), ',' ORDER BY lpad(substr(source, 7), 2, '0')) AS sources,
  coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS fields
FROM (SELECT page_id, source, CASE WHEN has_url THEN unnest([CASE WHEN licensed THEN 'creator' ELSE 'date' END,
  CASE WHEN has_image THEN 'institution' ELSE 'date' END]) ELSE unnest([NULL]) END AS f FROM v_cites)
GROUP BY page_id""",
)
def sources_and_evidence(spark, sf):
    entries = view(spark, sf, "v_cites").select(
        "page_id",
        F.lpad(F.substr("source", F.lit(7)), 2, "0").alias("source"),
        F.when(F.col("has_url"), "corroborated").alias("evidence"),
        F.array(
            F.when(F.col("licensed"), "creator").otherwise("date"),
            F.when(F.col("has_image"), "institution").otherwise("date"),
        ).alias("corroborated_by"),
    )
    registry = table(spark, sf, "part").select(
        F.lpad(F.substr("p_brand", F.lit(7)), 2, "0").alias("source")
    ).distinct().withColumn("ord", F.col("source").cast("int"))
    return M.sources_and_evidence(entries, registry)


@query(
    "sample_disclosure",
    f"""{with_views('v_cites')}
SELECT page_id, source, title AS topic, count(*) FILTER (WHERE has_image) AS shown, count(*) AS total,
  count(*) FILTER (WHERE has_image) < count(*) AS is_sample, bool_or(key_failed) AS at_least
FROM v_cites GROUP BY page_id, source, title HAVING count(*) FILTER (WHERE has_image) > 0""",
)
def sample_disclosure(spark, sf):
    found = view(spark, sf, "v_cites").withColumn("topic", F.col("title"))
    totals = found.groupBy("page_id", "source", "topic").agg(
        F.count("*").alias("total"), F.bool_or("key_failed").alias("truncated")
    )
    return M.sample_disclosure(found.filter("has_image"), totals)


PROSE = """SELECT page_id, section_ord, CAST(sum(length(title)) * 20 AS BIGINT) AS prose_chars
FROM v_cites GROUP BY page_id, section_ord"""


@query(
    "shelf_groups",
    f"""{with_views('v_cites')}, prose AS ({PROSE}),
g AS (SELECT page_id, section_ord, source, title AS topic, min(ord) AS first_ord, count(*) AS items, bool_or(has_image) AS img
  FROM v_cites GROUP BY ALL),
s AS (SELECT *, min(first_ord) OVER w AS source_first, count(*) OVER w AS topics
  FROM g WINDOW w AS (PARTITION BY page_id, section_ord, source))
SELECT page_id, section_ord, source, topic, first_ord, source_first, items, topics,
  items = 1 AND img AND prose_chars >= 700 AND section_ord > 1 AS gutter
FROM s JOIN prose USING (page_id, section_ord)""",
)
def shelf_groups(spark, sf):
    entries = view(spark, sf, "v_cites").withColumn("topic", F.col("title"))
    return M.shelf_groups(entries, sql_over(spark, sf, PROSE, "v_cites"))


@query(
    "link_strength",
    f"""{with_views('v_edges')}
SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT system) AS systems,
  CASE WHEN count(DISTINCT system) >= 4 THEN 'strong' WHEN count(DISTINCT system) >= 2 THEN 'medium' ELSE 'weak' END AS strength
FROM v_edges GROUP BY 1, 2""",
)
def link_strength(spark, sf):
    edges = view(spark, sf, "v_edges").withColumn("linked_via", F.array("system"))
    return M.link_strength(edges)


@query(
    "request_load",
    f"""{with_views('v_requests')},
e AS (SELECT host, epoch_us(ts) AS tm, 1 AS step FROM v_requests UNION ALL
  SELECT host, epoch_us(ts) + CAST(round(duration_s * 1000000) AS BIGINT), -1 FROM v_requests),
r AS (SELECT host, sum(step) OVER (PARTITION BY host ORDER BY tm, step ROWS UNBOUNDED PRECEDING) AS active FROM e)
SELECT host, (SELECT count(*) FROM v_requests q WHERE q.host = r.host) AS requests, CAST(max(active) AS BIGINT) AS peak
FROM r GROUP BY host""",
)
def request_load(spark, sf):
    return M.request_load(view(spark, sf, "v_requests"))


RENDERS = """SELECT event_id AS title, CASE WHEN event_type = 'error' AND value < 30 THEN 503
  WHEN event_type = 'error' THEN 404 ELSE 200 END AS status,
  event_type <> 'view' OR value < 100 AS complete, value > 300 AS timed_out,
  user_id AS host, event_type = 'click' OR value > 250 AS refused FROM events"""


@query(
    "warm_outcomes",
    f"""WITH r AS ({RENDERS}), k AS (SELECT *, CASE WHEN status = 200 AND complete AND NOT timed_out
  THEN CASE WHEN refused THEN 'thin' ELSE 'ok' END ELSE 'failed' END AS kind FROM r)
SELECT kind, CASE WHEN kind <> 'failed' THEN NULL WHEN timed_out THEN 'no answer' WHEN status = 503 THEN 'busy'
  WHEN NOT complete THEN 'stream cut short' ELSE concat('status ', CAST(status AS VARCHAR)) END AS reason,
  count(*) AS renders, NULL::BIGINT AS host, NULL::BIGINT AS thin_pages FROM k GROUP BY 1, 2
UNION ALL SELECT 'thin', NULL, NULL, host, count(*) FROM k WHERE kind = 'thin' GROUP BY host""",
)
def warm_outcomes(spark, sf):
    log = sql_over(spark, sf, RENDERS).withColumn(
        "thin", F.when(F.col("refused"), F.array("host")).otherwise(F.array().cast("array<bigint>"))
    )
    _, counts, hosts = M.warm_outcomes(log)
    return counts.unionByName(hosts.withColumn("kind", F.lit("thin")), allowMissingColumns=True)


@query(
    "open_tier_crosstab",
    """SELECT p_type AS tier, count(*) FILTER (WHERE p_size > 30 AND p_brand = 'Brand#1') AS "Brand#1",
  count(*) FILTER (WHERE p_size > 30 AND p_brand = 'Brand#2') AS "Brand#2",
  count(*) FILTER (WHERE p_size > 30 AND p_brand NOT IN ('Brand#1', 'Brand#2')) AS other,
  count(*) FILTER (WHERE p_size <= 30) AS "none", count(*) AS works,
  CAST(count(*) FILTER (WHERE p_size <= 30) AS DOUBLE) / count(*) AS share_none FROM part GROUP BY p_type""",
)
def open_tier_crosstab(spark, sf):
    works = table(spark, sf, "part").select(
        F.col("p_type").alias("tier"), F.when(F.col("p_size") > 30, F.col("p_brand")).alias("licence")
    )
    return M.open_tier_crosstab(works, ["Brand#1", "Brand#2"])


@query(
    "missing_image_census",
    f"""{with_views('v_pages')},
h AS (SELECT regexp_replace(lower(host), '^www\\.', '') AS host, count(*) AS entries,
  count(*) FILTER (WHERE length(html) < 3000) AS missing FROM v_pages GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY missing DESC, host) AS place, sum(missing) OVER () AS everything FROM h)
SELECT CASE WHEN place <= 10 THEN host ELSE 'other' END AS host, CAST(sum(entries) AS BIGINT) AS entries,
  CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(missing) AS DOUBLE) / CAST(max(everything) AS DOUBLE) AS share FROM k GROUP BY 1""",
)
def missing_image_census(spark, sf):
    entries = view(spark, sf, "v_pages").select(
        host_of(F.col("url")).alias("host"), F.when(F.length("html") >= 3000, F.col("url")).alias("image_url")
    )
    return M.missing_image_census(entries, 10)


@query(
    "entity_statement_stats",
    f"""{with_views('v_claims')}
SELECT property, rank, count(*) AS statements, count(*) FILTER (WHERE rank = 'deprecated') AS deprecated,
  count(*) FILTER (WHERE value_id % 3 = 0) AS unreferenced,
  CAST(count(*) FILTER (WHERE rank = 'deprecated') AS DOUBLE) / count(*) AS deprecated_share,
  CAST(count(*) FILTER (WHERE value_id % 3 = 0) AS DOUBLE) / count(*) AS unreferenced_share,
  CAST(grouping(property) * 2 + grouping(rank) AS BIGINT) AS "grouping"
FROM v_claims GROUP BY CUBE (property, rank)""",
)
def entity_statement_stats(spark, sf):
    claims = view(spark, sf, "v_claims").withColumn("reference_count", F.col("value_id") % 3)
    return M.entity_statement_stats(claims)


@query(
    "assemble_bands",
    f"""{with_views('v_cites')}
SELECT page_id, section_ord, ord, source, CAST(route AS BIGINT) AS route FROM (
  SELECT page_id, section_ord, ord, source, 0 AS route FROM v_cites WHERE licensed AND isbn IS NOT NULL UNION ALL
  SELECT page_id, section_ord, ord, source, 1 FROM v_cites WHERE doi IS NOT NULL UNION ALL
  SELECT page_id, section_ord, ord, source, 2 FROM v_cites WHERE cite_key IS NULL)""",
)
def assemble_bands(spark, sf):
    cites = view(spark, sf, "v_cites").select("page_id", "section_ord", "ord", "source", "licensed", "isbn", "doi", "cite_key")
    columns = ["page_id", "section_ord", "ord", "source"]
    routes = ("licensed AND isbn IS NOT NULL", "doi IS NOT NULL", "cite_key IS NULL")
    return M.assemble_bands([cites.filter(r).select(*columns) for r in routes])


@query(
    "unique_entries",
    f"""{with_views('v_holdings')}
SELECT title, partner AS description, min(id) AS ord FROM v_holdings GROUP BY 1, 2""",
)
def unique_entries(spark, sf):
    rows = view(spark, sf, "v_holdings").select(
        "title", F.col("partner").alias("description"), F.col("id").alias("ord")
    )
    return M.unique_entries(rows)


PASSES = """SELECT page_id, cite_key, {agg} AS answer FROM v_cites WHERE cite_key IS NOT NULL AND {which} GROUP BY 1, 2"""
LEDE = PASSES.format(agg="min(volume)", which="section_ord = 1")
REST = PASSES.format(agg="max(volume)", which="section_ord > 1")


@query(
    "merge_prefer_first",
    f"""{with_views('v_cites')}, a AS ({LEDE}), b AS ({REST})
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.cite_key, b.cite_key) AS cite_key,
  CASE WHEN a.page_id IS NOT NULL THEN a.answer ELSE b.answer END AS answer
FROM a FULL JOIN b ON a.page_id = b.page_id AND a.cite_key = b.cite_key""",
)
def merge_prefer_first(spark, sf):
    first, second = (sql_over(spark, sf, q, "v_cites") for q in (LEDE, REST))
    return M.merge_prefer_first(first, second, ["page_id", "cite_key"])


@query(
    "exclude_shown",
    f"""{with_views('v_cands', 'v_cites')}
SELECT c.* FROM v_cands c WHERE NOT EXISTS (SELECT 1 FROM v_cites x WHERE x.page_id = c.page_id
  AND x.cite_key = c.cand AND x.has_image AND x.section_ord = 1)""",
)
def exclude_shown(spark, sf):
    shown = view(spark, sf, "v_cites").filter("has_image AND section_ord = 1").select(
        "page_id", F.col("cite_key").alias("cand")
    )
    return M.exclude_shown(view(spark, sf, "v_cands"), shown.distinct(), ["page_id", "cand"])


STATUS = "CASE rank WHEN 'preferred' THEN 'Q19652' WHEN 'normal' THEN 'Q50423863' ELSE 'Q59496158' END"
RIGHTS_ROWS = f"""SELECT qid AS item, ord, {STATUS} AS status,
  CASE property WHEN 'P1' THEN 'United States' WHEN 'P2' THEN 'countries with 70 years pma or shorter' WHEN 'P3' THEN 'Mexico' END AS jurisdiction,
  CASE WHEN value_id % 4 = 0 THEN concat('method ', CAST(value_id AS STRING)) END AS how,
  CASE WHEN property = 'P6' THEN 'Creative Commons Attribution-ShareAlike 4.0' WHEN property = 'P7' THEN 'Creative Commons CC0 License' END AS licence_label,
  CASE WHEN property = 'P5' THEN 'Q71887839' END AS creator_status,
  CASE WHEN property = 'P5' THEN concat('Q', CAST(value_id AS STRING)) END AS creator,
  CASE WHEN property = 'P4' THEN 'Q73555012' END AS self_status FROM v_claims"""

CODES = "CASE status WHEN 'Q19652' THEN 'PD' WHEN 'Q50423863' THEN 'INC' WHEN 'Q59496158' THEN 'UNKNOWN' END"


def rights_rows(spark, sf):
    return sql_over(spark, sf, RIGHTS_ROWS, "v_claims")


@query(
    "rights_record",
    f"""{with_views('v_claims')}, rows AS ({RIGHTS_ROWS}),
st AS (SELECT item, status, jurisdiction, min(ord) AS ord, arg_min(how, ord) FILTER (WHERE how IS NOT NULL) AS how FROM rows GROUP BY 1, 2, 3),
w AS (SELECT item, string_agg(concat({CODES}, '@', coalesce(jurisdiction, ''), '=', coalesce(how, '')), '|' ORDER BY ord) AS work FROM st GROUP BY 1),
l AS (SELECT item, string_agg(code, '|' ORDER BY o) AS licences FROM (
  SELECT item, CASE WHEN licence_label LIKE '%CC0%' THEN 'CC0' ELSE 'CC BY-SA' END AS code, min(ord) AS o FROM rows
  WHERE licence_label IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT item, arg_min(creator, ord) FILTER (WHERE creator IS NOT NULL) AS creator,
  bool_or(self_status IS NOT NULL) AS self FROM rows GROUP BY 1)
SELECT item, work, licences, creator, self FROM p LEFT JOIN w USING (item) LEFT JOIN l USING (item)""",
)
def rights_record(spark, sf):
    rec = R.rights_record(rights_rows(spark, sf))
    return rec.select(
        "item",
        F.array_join(
            F.transform("work", lambda w: F.concat(
                w["status"]["code"], F.lit("@"), F.coalesce(w["jurisdiction"], F.lit("")), F.lit("="), F.coalesce(w["how"], F.lit(""))
            )), "|",
        ).alias("work"),
        F.array_join(F.transform("licences", lambda x: x["licence"]), "|").alias("licences"),
        F.col("creator.creator").alias("creator"),
        F.col("self").isNotNull().alias("self"),
    )


PHRASE = "CASE jurisdiction WHEN 'countries with 70 years pma or shorter' THEN 'PMA-70-OR-LESS' ELSE jurisdiction END"


@query(
    "rights_summary",
    f"""{with_views('v_claims')}, rows AS (SELECT *, {CODES} AS code, {PHRASE} AS place FROM ({RIGHTS_ROWS})),
places AS (SELECT item, string_agg(place, '; ' ORDER BY length(place), place) FILTER (WHERE code = 'PD') AS free_in,
  string_agg(place, '; ' ORDER BY length(place), place) FILTER (WHERE code = 'INC') AS bound_in
  FROM (SELECT DISTINCT item, code, place FROM rows WHERE place IS NOT NULL) GROUP BY item),
s AS (SELECT item, bool_or(code = 'PD') AS free, bool_or(code = 'INC') AS bound,
  bool_or(licence_label LIKE '%CC0%') AS cc0, bool_or(licence_label LIKE '%Share%') AS bysa,
  bool_or(creator_status IS NOT NULL) AS cre, bool_or(self_status IS NOT NULL) AS slf FROM rows GROUP BY item)
SELECT item, CASE WHEN free THEN 'PD' WHEN bound THEN 'INC' END AS lead_status,
  CASE WHEN cc0 THEN 'CC0' WHEN bysa THEN 'CC BY-SA' END AS lead_licence,
  CASE WHEN cre THEN 'EXPIRED' WHEN slf THEN 'PROTECTED' END AS creator_status,
  free, bound, free AND bound AS mixed, coalesce(free_in, '') AS free_in, coalesce(bound_in, '') AS bound_in,
  NOT free AND NOT bound AND NOT coalesce(cc0, false) AND NOT coalesce(bysa, false) AND NOT cre AND NOT slf AS open_question,
  CASE WHEN cc0 THEN 'cc zero' WHEN bysa AND NOT free THEN 'cc by sa' WHEN free THEN 'pd' WHEN bound THEN 'copyright'
    WHEN cre THEN 'pd' WHEN slf THEN 'copyright' END AS marks
FROM s LEFT JOIN places USING (item)""",
)
def rights_summary(spark, sf):
    return R.rights_summary(R.rights_record(rights_rows(spark, sf)))


@query(
    "attach_rights",
    f"""{with_views('v_cites')}
SELECT page_id, section_ord, ord, source AS item, CASE WHEN licensed THEN 'own-work' WHEN has_url THEN 'anchor' ELSE 'paper' END AS route,
  CASE WHEN licensed AND volume = 'borrow' THEN 'LENT' WHEN has_image THEN 'CC0' END AS rights_copy,
  CASE WHEN licensed AND volume = 'borrow' THEN NULL
    WHEN licensed THEN CASE WHEN NOT key_failed THEN concat('author of ', source) END
    WHEN has_url THEN concat('work of ', source) END AS rights_work
FROM v_cites""",
)
def attach_rights(spark, sf):
    entries = view(spark, sf, "v_cites").select(
        "page_id", "section_ord", "ord", F.col("source").alias("item"),
        F.when(F.col("licensed"), "own-work").when(F.col("has_url"), "anchor").otherwise("paper").alias("route"),
        F.when(F.col("has_image"), "CC0").alias("copy_code"),
        F.when(F.col("volume") == "borrow", "LENT").alias("loan_code"),
        (~F.col("key_failed")).alias("trusts_creator"),
    )
    rights = table(spark, sf, "part").select(F.col("p_brand").alias("item")).distinct().select(
        "item", F.concat(F.lit("author of "), "item").alias("creator_ruling"), F.concat(F.lit("work of "), "item").alias("work_ruling")
    )
    return R.attach_rights(entries, rights).drop("copy_code", "loan_code", "trusts_creator")


# Every licence line of every document, read as a URI, a slug or a label in turn; a document without one counts as such.
DOC_CODES = ("CC BY", "CC BY-SA", "CC BY-NC", "CC BY-ND", "CC BY-NC-SA", "CC BY-NC-ND")
DOC_LINES = r"icensed under (CC BY[A-Z-]*)|(MIT License)"


@query(
    "classify_licenses",
    f"""WITH d AS (SELECT source, unnest(CASE WHEN regexp_matches(text, '{DOC_LINES}') THEN list_concat(regexp_extract_all(text, 'icensed under (CC BY[A-Z-]*)', 1),
  list_transform(regexp_extract_all(text, 'MIT License'), lambda x: 'MIT')) ELSE [NULL] END) AS line FROM documents)
SELECT source, CASE WHEN line IN {DOC_CODES} THEN line END AS licence, count(*) AS n FROM d GROUP BY 1, 2""",
)
def classify_licenses(spark, sf):
    docs = table(spark, sf, "documents")
    line = F.concat(
        F.regexp_extract_all("text", F.lit("icensed under (CC BY[A-Z-]*)"), F.lit(1)), F.regexp_extract_all("text", F.lit("MIT License"), F.lit(0))
    )
    lines = docs.select("doc_id", "source", F.posexplode_outer(line).alias("k", "line"))
    slug = F.lower(F.replace("line", F.lit(" "), F.lit("-")))
    uri = F.concat(F.lit("https://creativecommons.org/licenses/"), F.replace(slug, F.lit("cc-"), F.lit("")), F.lit("/4.0/"))
    label = F.replace(F.replace("line", F.lit("CC BY"), F.lit("Creative Commons Attribution")), F.lit("-NC"), F.lit("-NonCommercial"))
    label = F.replace(F.replace(label, F.lit("-ND"), F.lit("-NoDerivs 4.0 International")), F.lit("-SA"), F.lit("-Share Alike 3.0"))
    turn = (F.coalesce("doc_id", F.lit(0)) + F.coalesce("k", F.lit(0))) % 3
    cc = F.col("line").startswith("CC")
    read = R.classify_licenses(lines, uri=F.when(cc & (turn == 0), uri), slug=F.when((turn == 1) | ~cc, slug), label=F.when(cc & (turn == 2), label))
    return R.license_census(read)
