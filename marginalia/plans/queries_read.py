"""Readers and extraction jobs over documents derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import extract as X
from marginalia.operators import matching as J
from marginalia.operators import quality as Q
from marginalia.plans import corpus as C
from marginalia.plans.catalog import query
from marginalia.plans.queries_match import CENSUS_SQL, CONTROL_CLASSES, census, subclass_control
from marginalia.plans.views import sql_over, table, view, with_views
from marginalia.session import cut_lineage, scratch_path
from marginalia.sources import readers as RD
from marginalia.sources import sinks as SK

SEC = with_views("v_sections")
LINES = f"{SEC}, x AS ({C.LINES})"
STITLE = f"st AS (SELECT page_id, section_ord, section_id, {C.SECTION_TITLE} AS stitle FROM v_sections JOIN orders ON o_orderkey = section_id)"
# Wiki text of every section, put together by plain aggregation.
BODIES = f"""{STITLE}, w AS (SELECT page_id, section_ord, string_agg({C.CITE_TEXT}, ' ' ORDER BY ord) AS wt FROM x GROUP BY 1, 2),
b AS (SELECT st.page_id, st.section_ord, stitle, coalesce(wt, '') AS wt FROM st LEFT JOIN w ON w.page_id = st.page_id AND w.section_ord = st.section_ord)"""
PAGES_WITH_CUSTOMER = "SELECT DISTINCT o_custkey AS page_id FROM orders"


def sections(spark, sf, reused=False):
    """Every section by itself, subsections apart; written out once where a
    query reads it several times."""
    every = X.slice_sections(C.articles(spark, sf, html=False), stop_at=2)
    return cut_lineage(every) if reused else every


@query(
    "read_articles",
    f"""{LINES}, {BODIES}
SELECT page_id, c_name AS title, count(*) AS sections,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS templates,
  (SELECT count(DISTINCT key) + 2 FROM x WHERE x.page_id = b.page_id AND ln = 2) AS links
FROM b JOIN customer ON c_custkey = page_id GROUP BY page_id, c_name, c_mktsegment""",
)
def read_articles(spark, sf):
    raw = C.articles(spark, sf).select(F.to_json(F.struct("*")).alias("raw"))
    # the list of sources at the end stands in for the lede in the count
    return RD.parse_articles(raw).select(
        "page_id", "title", F.size("sections").cast("bigint").alias("sections"), F.size("templates").alias("templates"),
        F.size("externallinks").cast("bigint").alias("links"),
    )


@query(
    "slice_sections",
    f"""{LINES}, {BODIES},
t AS (SELECT page_id, section_ord, stitle, CASE WHEN section_ord = 1 THEN rtrim('Lede ' || wt)
  ELSE rtrim(CASE WHEN section_ord % 3 = 0 THEN '=== ' || stitle || ' ===' ELSE '== ' || stitle || ' ==' END || chr(10) || wt, ' ' || chr(10)) END AS text FROM b)
SELECT page_id, section_ord, CASE WHEN section_ord = 1 THEN c_name ELSE stitle END AS title, md5(text) AS digest, length(text) AS chars
FROM t JOIN customer ON c_custkey = page_id""",
)
def slice_sections(spark, sf):
    return sections(spark, sf).filter("title <> 'Sources'").select(
        "page_id", "section_ord", "title", F.md5(F.encode("wikitext", "UTF-8")).alias("digest"), F.length("wikitext").cast("bigint").alias("chars")
    )


@query(
    "body_sections",
    f"""{SEC}, {STITLE}
SELECT page_id, section_ord, 'body' AS role FROM st WHERE section_ord = 1 OR stitle <> 'See also'
UNION ALL SELECT page_id, max(section_ord) + 1, 'sources' FROM st GROUP BY page_id""",
)
def body_sections(spark, sf):
    body, listed = X.body_sections(sections(spark, sf))
    return body.select("page_id", "section_ord", F.lit("body").alias("role")).unionByName(
        listed.select("page_id", "section_ord", F.lit("sources").alias("role"))
    )


CITED = """x2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY ord) AS ref FROM x WHERE ln <> 4)"""
KEY_TEXT = "CAST(key AS VARCHAR)"


@query(
    "citations",
    f"""{LINES}, {CITED}
SELECT page_id, section_ord, ref AS ord, CASE ln WHEN 1 THEN 'book' WHEN 2 THEN 'web' WHEN 3 THEN 'journal' WHEN 5 THEN 'generic' ELSE 'book' END AS kind,
  CASE ln WHEN 1 THEN 'http://a.example/?q=' || key WHEN 2 THEN 'https://www.' || host || '/p/' || key END AS url,
  CASE WHEN ln = 2 THEN 'https://web.archive.org/web/' || key END AS archive_url, CASE WHEN ln = 2 THEN '2020-01-02' END AS archive_date,
  CASE ln WHEN 1 THEN 'the ' || title || ' vol {{{{nowrap|x|y}}}}' WHEN 3 THEN title || ' again' ELSE title END AS title,
  CASE WHEN ln = 1 THEN CASE WHEN rf = 'R' THEN '978012' ELSE '9780' || key9 END END AS isbn,
  CASE ln WHEN 3 THEN '10.1/' || key WHEN 5 THEN '10.48550/arXiv.' || key END AS doi,
  CASE WHEN ln = 2 THEN 'Site ' || brand END AS publisher,
  CASE ln WHEN 1 THEN title WHEN 3 THEN 'B A, C, D et al.' WHEN 7 THEN title END AS author,
  CASE WHEN ln = 1 THEN '1998' END AS date, CASE WHEN ln = 2 AND rf = 'A' THEN '2021' END AS access_date, NULL::VARCHAR AS pmid
FROM x2 WHERE ln <> 6""",
)
def citations(spark, sf):
    return X.citations(sections(spark, sf))


BIB = """bib AS (SELECT page_id, noun || '|' || year AS key, arg_min(title, section_ord * 1000 + ord) AS title, arg_min('9781' || key9, section_ord * 1000 + ord) AS isbn,
  arg_min('Pub ' || brand, section_ord * 1000 + ord) AS publisher, any_value(year) AS date FROM x WHERE ln = 4 AND rf <> 'R' GROUP BY 1, 2)"""
POINTERS = """ptr AS (SELECT page_id, section_ord, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY ord) AS ord, noun || '|' || year AS key, year,
  CASE WHEN rf = 'A' THEN noun || ',other' ELSE noun END AS surnames FROM x WHERE ln = 4)"""
SHORT = "short AS (SELECT page_id, section_ord, min(ord) AS ord, key FROM ptr GROUP BY 1, 2, 4)"


def short_resolved(every):
    _, listed = X.body_sections(every)
    return J.resolve_short_cites(X.short_cites(every), X.bibliography(listed))


@query("short_cites", f"{LINES}, {POINTERS} SELECT * FROM ptr")
def short_cites(spark, sf):
    return X.short_cites(sections(spark, sf)).withColumn("surnames", F.array_join("surnames", ","))


@query("bibliography", f"{LINES}, {BIB} SELECT *, title AS author, NULL::VARCHAR AS oclc, NULL::VARCHAR AS lccn FROM bib")
def bibliography(spark, sf):
    _, listed = X.body_sections(sections(spark, sf))
    return X.bibliography(listed)


@query(
    "resolve_short_cites",
    f"""{LINES}, {BIB}, {POINTERS}, {SHORT}
SELECT s.page_id, s.section_ord, s.ord, s.key, bib.title, bib.isbn FROM short s JOIN bib ON bib.page_id = s.page_id AND bib.key = s.key""",
)
def resolve_short_cites(spark, sf):
    return short_resolved(sections(spark, sf, reused=True)).select("page_id", "section_ord", "ord", "key", "title", "isbn")


@query(
    "identified_cites",
    f"""{LINES}, {CITED}, {BIB}, {POINTERS}, {SHORT},
a AS (SELECT page_id, section_ord, ref AS ord, false AS via_short, CASE WHEN ln = 1 THEN '9780' || key9 END AS isbn, CASE WHEN ln = 7 THEN {KEY_TEXT} END AS oclc,
  CASE WHEN ln = 1 THEN adj || ' ' || noun || '|the ' || title || ' vol {{{{nowrap|x|y}}}}' ELSE title END AS title
  FROM x2 WHERE (ln = 1 AND rf <> 'R') OR ln = 7
 UNION ALL SELECT s.page_id, s.section_ord, s.ord, true, bib.isbn, NULL, bib.title FROM short s JOIN bib ON bib.page_id = s.page_id AND bib.key = s.key),
n AS (SELECT *, coalesce(isbn, oclc) AS cite_key, row_number() OVER (PARTITION BY page_id, section_ord, coalesce(isbn, oclc) ORDER BY via_short, ord) AS n FROM a)
SELECT page_id, section_ord, ord, via_short, isbn, oclc, title, cite_key FROM n WHERE n = 1""",
)
def identified_cites(spark, sf):
    every = sections(spark, sf, reused=True)
    return X.identified_cites(every, short_resolved(every)).drop("lccn")


@query(
    "scholarly_cites",
    f"""{LINES}, {CITED}, a AS (SELECT page_id, section_ord, min(ref) AS ord, CASE WHEN ln = 3 THEN '10.1/' || key END AS doi, CASE WHEN ln = 5 THEN {KEY_TEXT} END AS arxiv,
  any_value(CASE WHEN ln = 3 THEN title || ' again' ELSE title END) AS title FROM x2 WHERE ln IN (3, 5) GROUP BY page_id, section_ord, ln, key)
SELECT *, coalesce(doi, arxiv) AS cite_key FROM a""",
)
def scholarly_cites(spark, sf):
    return X.scholarly_cites(sections(spark, sf)).drop("pmid")


@query(
    "text_blocks",
    """WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g') AS html FROM pages),
b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS b FROM h),
t AS (SELECT page_id, regexp_replace(regexp_replace(b, '(?s)<!--.*?(-->|$)', '', 'g'), '<[^<>]+>', '', 'g') AS t FROM b),
d AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&#39;', ''''), '&#8217;', '’'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM t)
SELECT page_id, count(*) AS blocks, CAST(sum(length(t)) AS BIGINT) AS prose_chars, md5(string_agg(t, '' ORDER BY t)) AS digest FROM d WHERE length(t) >= 2 GROUP BY page_id""",
)
def text_blocks(spark, sf):
    pages = table(spark, sf, "pages").withColumn("section_ord", F.lit(1))
    blocks, _ = X.text_blocks(pages)
    return blocks.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("prose_chars"),
        F.md5(F.encode(F.array_join(F.array_sort(F.collect_list("text")), ""), "UTF-8")).alias("digest"),
    )


@query(
    "prose_links",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href="/([^"#:?]+)"[^>]*>', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM a),
t AS (SELECT page_id, replace(CASE WHEN raw LIKE '%\\%%' ESCAPE '\\' THEN url_decode(raw) ELSE raw END, '_', ' ') AS title, min(pos) AS pos FROM u GROUP BY 1, 2),
r AS (SELECT page_id, title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ord FROM t
  WHERE NOT regexp_matches(title, '^(?i)(ISBN|ISSN|OCLC|Doi|Digital object identifier|Wayback Machine|JSTOR|Bibcode|LCCN|International Standard|Library of Congress Control Number|PMID|S2CID|Google Books)'))
SELECT page_id, title, ord FROM r WHERE ord <= 24""",
)
def prose_links(spark, sf):
    pages = table(spark, sf, "pages").withColumn("section_ord", F.lit(1))
    return X.prose_links(pages, 24, prefix="/").drop("section_ord")


@query(
    "section_links",
    f"""{LINES}, t AS (SELECT page_id, section_ord, title, min(ord) AS o FROM x GROUP BY 1, 2, 3
 UNION ALL SELECT c_custkey, 1, 'Seg ' || c_mktsegment, 0 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT page_id, section_ord, title, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY o) AS ord FROM t""",
)
def section_links(spark, sf):
    return X.prose_links(X.section_html(C.articles(spark, sf), stop_at=2), 24).filter("title <> 'Sources'")


@query(
    "resolve_titles",
    f"""{LINES}, t AS (SELECT DISTINCT upper(title[1]) || title[2:] AS title FROM x),
red AS (SELECT DISTINCT p_name AS f, split_part(p_name, ' ', 1) || ' plate' AS t FROM part WHERE p_name LIKE '% ring'),
props AS (SELECT p_name AS title, 'Q' || min(p_partkey) AS qid FROM part WHERE p_name NOT LIKE '% bolt' GROUP BY 1)
SELECT t.title, qid FROM t LEFT JOIN red ON upper(f[1]) || f[2:] = t.title
LEFT JOIN props ON upper(props.title[1]) || props.title[2:] = coalesce(upper(red.t[1]) || red.t[2:], t.title)""",
)
def resolve_titles(spark, sf):
    part = table(spark, sf, "part").select("p_name", "p_partkey")
    titles = C.lines(spark, sf).select(F.replace("title", F.lit(" "), F.lit("_")).alias("title"))
    redirects = part.filter("p_name LIKE '% ring'").select(
        F.col("p_name").alias("from"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_plate")).alias("to")
    )
    props = part.filter("p_name NOT LIKE '% bolt'").groupBy(F.col("p_name").alias("title")).agg(
        F.concat(F.lit("Q"), F.min("p_partkey").cast("string")).alias("qid")
    )
    return J.resolve_titles(titles, redirects, props)


CUST = f"c AS (SELECT * FROM customer WHERE c_custkey IN ({PAGES_WITH_CUSTOMER}))"


@query(
    "infobox_links",
    f"""WITH {CUST} SELECT c_custkey AS page_id, 'Mr ' || c_custkey AS title, 1::BIGINT AS ord FROM c
UNION ALL SELECT c_custkey, 'Seg ' || c_mktsegment, 3 FROM c""",
)
def infobox_links(spark, sf):
    return X.infobox_links(C.articles(spark, sf))


@query(
    "infobox_rows",
    f"""WITH {CUST} SELECT c_custkey AS page_id, 1::BIGINT AS ord, 'Artist' AS label, c_name AS value FROM c
UNION ALL SELECT c_custkey, 5, 'Type & kind', lower(c_mktsegment) || ' fs' FROM c""",
)
def infobox_rows(spark, sf):
    return X.infobox_rows(C.articles(spark, sf))


@query(
    "reference_notes",
    f"""{LINES} SELECT DISTINCT page_id, 'k' || key AS name, 'Book <a href="/wiki/Special:BookSources/978-0-' || key9 || '">isbn</a>' AS body FROM x""",
)
def reference_notes(spark, sf):
    return X.reference_notes(C.articles(spark, sf))


ACCESS = "SELECT page_id, section_ord, '9780' || lpad(CAST(cite_key AS STRING), 9, '0') AS isbn, volume AS access FROM v_cites WHERE cite_key IS NOT NULL AND NOT key_failed"


@query(
    "footnotes",
    f"""{with_views('v_sections', 'v_cites')}, x AS ({C.LINES}),
m AS (SELECT page_id, section_ord, key, key9, min(ord) AS first_ord FROM x GROUP BY 1, 2, 3, 4),
acc AS (SELECT page_id, section_ord, isbn, min(access) AS access FROM ({ACCESS}) WHERE access IS NOT NULL GROUP BY 1, 2, 3)
SELECT m.page_id, m.section_ord, 'k' || key AS name, first_ord AS block, CAST(first_ord AS VARCHAR) AS num, '9780' || key9 AS isbn, access
FROM m LEFT JOIN acc ON acc.page_id = m.page_id AND acc.section_ord = m.section_ord AND acc.isbn = '9780' || key9""",
)
def footnotes(spark, sf):
    pages = cut_lineage(C.articles(spark, sf).select("page_id", "title", "html", "sections"))
    blocks, _ = X.text_blocks(X.section_html(pages, stop_at=2), keep_markers=True)
    notes = J.footnotes(X.note_markers(blocks), X.reference_notes(pages), sql_over(spark, sf, ACCESS, "v_cites"))
    return notes.select("page_id", "section_ord", "name", F.col("ord.block").alias("block"), "num", "isbn", "access")


@query(
    "article_reach",
    f"""{LINES}, h AS (SELECT DISTINCT page_id, host FROM x WHERE ln = 2)
SELECT c_custkey AS page_id, host, c_mktsegment = 'MACHINERY' AS kartographer, c_mktsegment = 'BUILDING' AS identifier_bar
FROM customer JOIN ({PAGES_WITH_CUSTOMER}) p ON p.page_id = c_custkey LEFT JOIN h ON h.page_id = c_custkey""",
)
def article_reach(spark, sf):
    hosts, flags = X.article_reach(C.articles(spark, sf))
    return flags.drop("templates").join(hosts, "page_id", "left")


URLS = """SELECT CASE p_size % 6 WHEN 0 THEN 'https://archive.org/details/' || split_part(p_name, ' ', 1) || p_partkey || '?view=x'
  WHEN 1 THEN 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') || '#Top' WHEN 2 THEN 'http://www.wikidata.org/entity/Q' || p_partkey
  WHEN 3 THEN 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/' || replace(p_name, ' ', '%20') || '.jpg/220px-x.jpg'
  WHEN 4 THEN 'https://archive.org/search?q=' || p_partkey ELSE 'https://en.wikipedia.org/w/index.php?title=' || p_partkey END AS url FROM part
UNION ALL SELECT url FROM pages"""


@query(
    "url_identifiers",
    f"""WITH u AS ({URLS}), k AS (SELECT *, CASE WHEN url LIKE 'https://archive.org/details/%' THEN 'archive' WHEN url LIKE 'https://en.wikipedia.org/wiki/%' THEN 'article'
    WHEN url LIKE '%wikidata.org/entity/Q%' THEN 'entity' WHEN url LIKE 'https://upload.wikimedia.org/%' THEN 'file' END AS kind,
  regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host FROM u),
s AS (SELECT host, kind, count(*) AS urls, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY host) AS DOUBLE) AS share FROM k GROUP BY 1, 2),
i AS (SELECT *, CASE kind WHEN 'archive' THEN regexp_extract(url, 'details/([a-z0-9]+)', 1) WHEN 'entity' THEN regexp_extract(url, 'Q[0-9]+')
  WHEN 'article' THEN replace(regexp_extract(url, 'wiki/([^#]+)', 1), '_', ' ') ELSE replace(regexp_extract(url, 'ab/([^/]+)/', 1), '%20', ' ') END AS name FROM k WHERE kind IS NOT NULL)
SELECT i.host, i.kind, name AS id, count(*) AS n, any_value(urls) AS urls, any_value(share) AS share
FROM i JOIN s ON s.host = i.host AND s.kind = i.kind GROUP BY 1, 2, 3""",
)
def url_identifiers(spark, sf):
    """The real rules over addresses of all kinds, and the given pages, which none of them knows."""
    urls = sql_over(spark, sf, URLS.replace("FROM pages", "FROM v_pages"), "v_pages")
    found, shares = X.url_identifiers(urls, "url")
    counted = found.groupBy("host", "kind", "id").agg(F.count("*").alias("n"))
    return counted.join(shares, ["host", "kind"])


REPORTED = """SELECT qid, property, ord, CASE WHEN value_id % 3 = 0 THEN CAST(value_id AS STRING) || ' U.S. ' || CAST(ord AS STRING)
  WHEN value_id % 3 = 1 THEN ' ' || CAST(value_id AS STRING) || ' F. Supp. 2d ' || CAST(ord AS STRING) ELSE 'no citation' END AS value FROM v_claims"""


@query(
    "reporter_cites",
    f"""{with_views('v_claims')}, r AS (SELECT qid, ord, value_id % 3 AS m, value_id FROM v_claims WHERE property = 'P2' AND value_id % 3 < 2),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, ord) AS n FROM r)
SELECT qid, CAST(value_id AS VARCHAR) AS volume, CASE m WHEN 0 THEN 'U.S.' ELSE 'F. Supp. 2d' END AS reporter, CAST(ord AS VARCHAR) AS page FROM n WHERE n = 1""",
)
def reporter_cites(spark, sf):
    return X.reporter_cites(sql_over(spark, sf, REPORTED, "v_claims"), "P2")


@query(
    "citation_audit",
    f"""{LINES}, r AS (SELECT page_id, count(*) FILTER (WHERE ln <> 4) AS refs, count(*) FILTER (WHERE ln = 6 AND rf = 'R') AS bare_urls,
  count(*) FILTER (WHERE ln = 2 AND rf <> 'A') AS undated_web, count(*) FILTER (WHERE ln = 7) AS without_id,
  count(*) FILTER (WHERE ln = 2 AND brand = 'Brand#9') AS circular,
  (count(*) FILTER (WHERE ln IN (1, 2, 3, 7)) > 0)::INT + (count(*) FILTER (WHERE ln = 5) > 0)::INT + (count(*) FILTER (WHERE ln = 6) > 0)::INT > 1 AS mixed_styles FROM x GROUP BY page_id)
SELECT r.*, n AS uncited_paragraphs FROM r JOIN (SELECT page_id, count(*) FILTER (WHERE key % 10 = 5) AS n FROM x GROUP BY page_id) USING (page_id)""",
)
def citation_audit(spark, sf):
    pages = cut_lineage(C.articles(spark, sf).select("page_id", "title", "html", "wikitext", "sections"))
    refs = X.ref_styles(X.slice_sections(pages, stop_at=2)).withColumn(
        "url", F.when(F.col("url").contains("brand-9."), F.lit("https://en.wikipedia.org/wiki/X")).otherwise(F.col("url"))
    )
    # Lines whose key ends in 5 have lost their marker.
    bare = F.regexp_replace("html", r'<sup class="reference"><a href="#cite_note-k\d*5">[^<]*</a></sup>', "")
    blocks, _ = X.text_blocks(X.section_html(pages.withColumn("html", bare), stop_at=2), keep_markers=True)
    marked = blocks.withColumn("has_marker", F.contains("html", F.lit('href="#cite_note-')))
    return Q.citation_audit(refs, marked)


# --- readers --------------------------------------------------------------------


@query(
    "read_entity_claims",
    f"""{with_views('v_claims')}
SELECT 'Q' || qid AS qid, property, row_number() OVER (PARTITION BY qid, property ORDER BY ord) AS ord, rank,
  CASE WHEN property <= 'P3' THEN 'entity' WHEN property = 'P4' THEN 'point' WHEN property = 'P5' THEN 'time' ELSE 'string' END AS kind,
  CASE WHEN property <= 'P3' THEN 'Q' || value_id END AS value_id,
  CASE WHEN property = 'P5' THEN '+' || (1900 + value_id % 100) || '-00-00T00:00:00Z' WHEN property = 'P6' THEN 'id ' || value_id END AS value_str,
  CASE WHEN property = 'P4' THEN value_id % 90 + CAST(0.5 AS DOUBLE) END AS lat, CASE WHEN property = 'P4' THEN -(value_id % 180 + CAST(0.25 AS DOUBLE)) END AS lon,
  CASE WHEN ord % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS reference_count, CAST(ord AS VARCHAR) AS started
FROM v_claims WHERE property <> 'P7'""",
)
def read_entity_claims(spark, sf):
    claims = RD.parse_entity_claims(C.entity_documents(spark, sf))
    return claims.withColumn("started", F.try_element_at("qualifiers", F.lit("P580"))).drop("qualifiers")


@query(
    "read_sparql_bindings",
    f"""{with_views('v_claims')} SELECT 'Q' || qid AS work, CASE WHEN value_id % 5 > 0 THEN 'label ' || value_id END AS label, 'Q' || value_id AS class FROM v_claims WHERE rank <> 'deprecated'""",
)
def read_sparql_bindings(spark, sf):
    raw = sql_over(
        spark, sf,
        """SELECT '{"results":{"bindings":[' || concat_ws(',', collect_list('{"work":{"type":"uri","value":"' || CASE WHEN rank = 'deprecated' THEN 'bad' ELSE 'http://www.wikidata.org/entity/Q' || qid END || '"},' ||
        CASE WHEN value_id % 5 > 0 THEN '"label":{"value":"label ' || value_id || '"},' ELSE '' END || '"class":{"value":"http://www.wikidata.org/entity/Q' || value_id || '"}}')) || ']}}' AS raw
        FROM v_claims GROUP BY qid""", "v_claims",
    )
    return RD.parse_sparql_bindings(raw, ["work", "label", "class"], "work")


@query(
    "read_holdings",
    """WITH p AS (SELECT *, p_size % 6 AS n, p_size <= 25 AS pd, p_size % 4 > 0 AS img, p_size % 7 > 0 AS obj, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT CASE n WHEN 0 THEN 'met' WHEN 1 THEN 'artic' WHEN 2 THEN 'cleveland' WHEN 3 THEN 'getty' WHEN 4 THEN 'rijks' ELSE 'iiif' END AS partner,
  CASE WHEN n = 5 THEN 'http://manifest.example/' || k ELSE k END AS id, p_name AS title,
  CASE WHEN n <= 3 THEN p_brand END AS creator, CASE WHEN n <= 3 THEN p_type END AS medium,
  CASE WHEN n = 4 THEN 'SK-' || k WHEN n = 2 THEN k END AS accession, pd AS public_domain,
  CASE WHEN n = 4 THEN CASE WHEN pd THEN 'PDM' ELSE 'INC' END WHEN n = 5 THEN CASE WHEN pd THEN 'PDM' ELSE 'INC' END WHEN pd THEN 'CC0' END AS rights_label,
  CASE WHEN pd AND img THEN CASE n WHEN 1 THEN 'http://iiif.example/2/i' || k || '/full/800,/0/default.jpg' WHEN 3 THEN 'http://img.example/' || k || '/full/!800,800/0/default.jpg'
    WHEN 4 THEN 'http://img.example/' || k || '/full/800,/0/default.jpg' WHEN 5 THEN 'http://img.example/' || k || '/full/800,/0/default.jpg' ELSE 'http://img.example/' || k END END AS image_url,
  CASE n WHEN 0 THEN img::INT + 2 WHEN 1 THEN img::INT WHEN 2 THEN img::INT WHEN 5 THEN 1 END AS image_count,
  CASE n WHEN 1 THEN 'https://www.artic.edu/artworks/' || k WHEN 3 THEN 'http://getty.example/object/' || k || '/' WHEN 4 THEN 'https://www.rijksmuseum.nl/en/collection/SK-' || k
    WHEN 5 THEN CASE WHEN obj THEN 'http://obj.example/' || k ELSE 'http://manifest.example/' || k END ELSE CASE WHEN obj THEN 'http://obj.example/' || k END END AS href,
  CASE n WHEN 0 THEN 'The Metropolitan Museum of Art' WHEN 1 THEN 'Art Institute of Chicago' WHEN 2 THEN 'Cleveland Museum of Art' WHEN 3 THEN 'J. Paul Getty Museum' WHEN 4 THEN 'Rijksmuseum'
    ELSE CASE WHEN p_size > 12 THEN p_type END END AS institution,
  CASE WHEN n = 5 AND p_size <= 12 THEN 2 ELSE 1 END AS providers FROM p""",
)
def read_holdings(spark, sf):
    return RD.parse_holdings(C.holding_documents(spark, sf)).drop("date", "dimensions", "credit", "rights_uri")


@query(
    "read_aggregator_docs",
    """WITH p AS (SELECT *, p_size % 4 AS n, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT CASE n WHEN 0 THEN 'dpla' WHEN 1 THEN 'europeana' WHEN 2 THEN 'digitalnz' ELSE 'smithsonian' END AS source, k AS id, p_name AS title, p_type AS provider,
  CASE WHEN n = 2 OR (n = 0 AND p_size > 30) THEN p_brand || '|' || p_type ELSE '' END AS subjects,
  CASE n WHEN 2 THEN CASE WHEN p_size <= 20 THEN NULL WHEN p_size <= 35 THEN 'INC' ELSE 'UNKNOWN' END WHEN 3 THEN CASE WHEN p_size <= 20 THEN 'CC0' END
    ELSE CASE WHEN p_size <= 20 THEN 'CC BY-SA' WHEN p_size <= 35 THEN 'NOCUS' END END AS rights_code,
  'http://t.example/' || k || CASE WHEN n = 3 THEN '?max=800' ELSE '' END AS image_url,
  CASE n WHEN 0 THEN 'https://dp.la/item/' || k WHEN 1 THEN 'http://e.example/' || k WHEN 2 THEN 'https://digitalnz.org/records/' || k ELSE 'http://s.example/' || k END AS href,
  CASE WHEN n = 3 AND p_size > 25 THEN 1 ELSE 0 END::BIGINT AS models, CASE WHEN n = 3 THEN p_name ELSE '' END AS names,
  CASE WHEN n = 3 AND p_size > 25 THEN 'Ape: ' || p_type WHEN n = 3 THEN '' END AS scan_subject FROM p""",
)
def read_aggregator_docs(spark, sf):
    entries = RD.parse_aggregator_docs(C.aggregator_documents(spark, sf))
    return entries.withColumns({
        "subjects": F.array_join("subjects", "|"), "names": F.array_join("names", "|"),
        "scan_subject": F.when(F.col("source") == "smithsonian", F.coalesce("scan_subject", F.lit(""))),
    }).drop("rights_uri")


@query(
    "read_bibliographic",
    """WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT 'archive' AS kind, 'doc' || k AS id, p_name AS a, CASE WHEN p_size > 10 THEN k || ',alt' || k ELSE '' END AS b, CASE WHEN p_size > 25 THEN 'CC BY-NC' END AS c, (1900 + p_size)::BIGINT AS n FROM p
UNION ALL SELECT 'volumes', k, CASE WHEN p_size > 40 THEN 'full' WHEN p_size > 30 THEN 'borrow' ELSE 'catalog' END,
  CASE WHEN p_size > 45 THEN 'http://read.example/' || k WHEN p_size > 30 THEN 'http://pre.example/' || k ELSE 'https://ol.example/' || k END, NULL, NULL FROM p WHERE p_size > 30 OR p_size % 5 > 0
UNION ALL SELECT 'author_works', '/works/' || k, p_name, p_brand, CASE WHEN p_size > 25 THEN 'scan' || k END, p_size FROM p
UNION ALL SELECT 'author_works', '/works/' || k, p_name, p_type, CASE WHEN p_size > 25 THEN 'scan' || k END, p_size FROM p WHERE p_size > 20
UNION ALL SELECT 'papers', 'W' || k, p_brand, k, CASE WHEN p_size > 40 THEN 'CC BY-NC' END, p_size FROM p
UNION ALL SELECT 'notices', '10.1/' || k, 'updated-by', '10.2/' || k, 'retraction', NULL FROM p WHERE p_size > 45
UNION ALL SELECT 'notices', '10.1/' || k, 'update-to', '10.3/' || k, 'correction', NULL FROM p WHERE p_size < 3""",
)
def read_bibliographic(spark, sf):
    t = RD.parse_bibliographic(C.bibliographic_documents(spark, sf))
    none = F.lit(None).cast("bigint")
    shapes = {
        "archive": ["doc_id", "title", F.array_join("isbns", ","), "licence", F.col("year").cast("bigint")],
        "volumes": ["isbn", "availability", "url", F.lit(None).cast("string"), none],
        "author_works": ["key", "title", "author", "scan_id", "editions"],
        "papers": ["work_id", "first_author", "pmid", "licence", "cited_by"],
        "notices": ["doi", "direction", "other", "type", none],
    }
    out = None
    for kind, columns in shapes.items():
        cols = [(F.col(c) if isinstance(c, str) else c).alias(a) for c, a in zip(columns, ("id", "a", "b", "c", "n"))]
        frame = t[kind].select(F.lit(kind).alias("kind"), *cols)
        out = frame if out is None else out.unionByName(frame)
    return out


@query(
    "read_taxa",
    """WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT 'inaturalist' AS source, k AS id, CASE WHEN p_size > 10 THEN p_type || ' (' || p_name || ')' ELSE p_name END AS title, p_size::BIGINT AS count,
  CASE WHEN p_size > 5 THEN 'http://photo.example/b/' || k ELSE 'http://photo.example/a/' || k END AS image_url, CASE WHEN p_size > 5 THEN 'CC BY' ELSE 'CC BY-NC' END AS licence,
  'by ' || p_brand AS attribution, 'https://www.inaturalist.org/taxa/' || k AS href FROM p WHERE p_size <= 25
UNION ALL SELECT 'gbif', k, CASE WHEN p_size > 40 THEN p_name ELSE p_name || ' L.' END, NULL, NULL, NULL, NULL, 'https://www.gbif.org/species/' || k FROM p WHERE p_size > 25""",
)
def read_taxa(spark, sf):
    return RD.parse_taxa(C.taxon_documents(spark, sf))


@query(
    "read_authority_labels",
    """WITH p AS (SELECT *, CASE WHEN p_size > 25 THEN 'sh' ELSE 'n' END || p_partkey AS id FROM part WHERE p_size > 3)
SELECT id, p_name AS form, 'heading' AS kind, 0::BIGINT AS ord FROM p UNION ALL SELECT id, p_brand, 'variant', 1 FROM p UNION ALL SELECT id, p_type, 'variant', 2 FROM p""",
)
def read_authority_labels(spark, sf):
    return RD.parse_authority_labels(C.authority_documents(spark, sf))


@query(
    "read_curated_graph",
    f"""{with_views('v_edges')}
SELECT src AS a, dst AS b, type AS c, string_agg(DISTINCT system, ',' ORDER BY system) AS d, NULL::BIGINT AS potential FROM v_edges GROUP BY src, dst, type
UNION ALL SELECT 'p' || p_partkey, p_brand, p_name, CASE WHEN p_size > 25 THEN 'Q' || p_partkey END, p_size FROM part
UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, NULL, NULL FROM supplier""",
)
def read_curated_graph(spark, sf):
    nodes, edges = RD.parse_curated_graph(*C.graph_documents(spark, sf))
    none = F.lit(None).cast("bigint")
    return edges.select(
        F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c"), F.array_join("linked_via", ",").alias("d"), none.alias("potential")
    ).unionByName(
        nodes.select(F.col("id").alias("a"), F.col("source").alias("b"), F.col("title").alias("c"), F.col("qid").alias("d"), "potential")
    )


# --- sinks -----------------------------------------------------------------------


@query(
    "write_bands",
    f"""{with_views('v_cites')} SELECT page_id, section_ord, count(*) AS entries, count(*) FILTER (WHERE volume IN ('full', 'borrow') AND isbn IS NOT NULL AND NOT key_failed) AS open
FROM v_cites GROUP BY 1, 2""",
)
def write_bands(spark, sf):
    from marginalia.plans.queries_measure import coverage

    bands = coverage(spark, sf).select("page_id", "section_ord", F.col("total").alias("entries"), "open")
    path = scratch_path(spark, "bands")
    SK.write_bands(bands, path)
    return SK.read_committed(spark, path)["bands"]


@query(
    "write_census",
    f"""{with_views('v_claims', 'v_class').replace('WITH', 'WITH RECURSIVE', 1)}, {CENSUS_SQL}, ctl AS ({CONTROL_CLASSES}),
up AS (SELECT child AS class, parent AS super FROM v_class UNION SELECT up.class, v.parent FROM up JOIN v_class v ON v.child = up.super),
kind AS (SELECT qid, value_id AS class FROM best WHERE property = 'P6'),
only_sub AS (SELECT count(DISTINCT qid) AS n FROM kind WHERE class IN (SELECT class FROM up WHERE super IN (SELECT class FROM ctl) AND super <> class)
  AND qid NOT IN (SELECT qid FROM kind WHERE class IN (SELECT class FROM ctl)) AND qid IN (SELECT qid FROM sl)
  AND qid IN (SELECT qid FROM best JOIN reg ON reg.property = best.property))
SELECT 'rows' AS part, qid, property AS name, CAST(id AS VARCHAR) AS id, title, (SELECT count(DISTINCT value_id) FROM best c WHERE c.qid = rows.qid AND c.property = 'P4') AS n,
  NULL::BIGINT AS subclass_only, '2026-08-17' AS queried FROM rows
UNION ALL SELECT 'holders', NULL, partner, NULL, NULL, count(*), NULL, '2026-08-17' FROM pick WHERE n = 1 AND qid IN (SELECT qid FROM rows) GROUP BY partner
UNION ALL SELECT 'summary', count(DISTINCT qid), NULL, NULL, NULL, count(*), (SELECT n FROM only_sub), '2026-08-17' FROM rows""",
)
def write_census(spark, sf):
    """A census of holders written, and all three tables read back."""
    path = scratch_path(spark, "census")
    SK.write_census(*census(spark, sf), subclass_control(spark, sf), "2026-08-17", path)
    held = SK.read_committed(spark, path)
    day = F.col("queried").cast("string").alias("queried")
    rows = held["rows"].select(
        F.lit("rows").alias("part"), "qid", F.col("property").alias("name"), F.col("id").cast("string").alias("id"), "title", F.col("collections").alias("n"), day
    )
    holders = held["holders"].select(F.lit("holders").alias("part"), F.col("partner").alias("name"), F.col("items").alias("n"), day)
    summary = held["summary"].select(F.lit("summary").alias("part"), F.col("items").alias("qid"), F.col("rows").alias("n"), "subclass_only", day)
    return rows.unionByName(holders, allowMissingColumns=True).unionByName(summary, allowMissingColumns=True)
