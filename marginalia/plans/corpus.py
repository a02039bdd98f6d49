"""Documents that Spark derives from the given tables: article text and JSON
records in the layouts the readers take. Their size grows with the tables, and
what a reader must find in them can be told from the tables by plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.plans.views import sql_over, table

# One row per cited line: a page is a customer, a section an order, a line an
# item of it. The expressions below run in Spark and in DuckDB alike.
LINES = """SELECT s.page_id, s.section_ord, s.section_id,
  row_number() OVER (PARTITION BY s.page_id, s.section_ord ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS ord,
  l.l_linenumber AS ln, l.l_partkey AS key, l.l_returnflag AS rf, p.p_name AS title, p.p_brand AS brand, p.p_size AS size,
  split_part(p.p_name, ' ', 1) AS adj, split_part(p.p_name, ' ', 2) AS noun, lpad(CAST(l.l_partkey AS STRING), 9, '0') AS key9,
  CAST(1990 + p.p_size % 20 AS STRING) AS year, lower(replace(p.p_brand, '#', '-')) || '.example.org' AS host
FROM v_sections s JOIN lineitem l ON l.l_orderkey = s.section_id JOIN part p ON p.p_partkey = l.l_partkey"""

CITE_TEXT = """CASE ln
 WHEN 1 THEN '<ref name="k' || key || '">{{cite book |last=' || noun || ' |first=' || adj || ' |title=[[' || adj || ' ' || noun || '|the ' || title || ']] vol {{nowrap|x|y}} |isbn=' ||
   CASE WHEN rf = 'R' THEN '978-0-12' ELSE '978-0-' || key9 END || ' |year=1998 |url=http://a.example/?q=' || key || '}}</ref>'
 WHEN 2 THEN '<ref>{{Cite web |url=https://www.' || host || '/p/' || key || ' |title=''''''' || title || ''''''' |archive-url=https://web.archive.org/web/' || key || ' |archive-date=2020-01-02 |website=Site ' || brand || CASE WHEN rf = 'A' THEN ' |access-date=2021' ELSE '' END || '}}</ref>'
 WHEN 3 THEN '<ref group="n">{{ cite journal |doi=10.1/' || key || ' |title=old |title=' || title || ' again |last1=A |first1=B |last2=C |last3=D |last4=E }}</ref>'
 WHEN 4 THEN CASE WHEN rf = 'A' THEN '{{harvnb|' || noun || '|Other|' || year || '}}' ELSE '{{sfn|' || noun || '|' || year || '|p=3}}' END
 WHEN 5 THEN '<ref>{{citation |doi=10.48550/arXiv.' || key || ' |title=' || title || ' }}</ref>'
 WHEN 6 THEN '<ref name="k1" /> then <ref>' || CASE WHEN rf = 'R' THEN 'http://bare.example/' || key ELSE 'plain text of ' || brand END || '</ref>'
 ELSE '<ref>{{cite book |title=' || title || ' |oclc=' || key || ' |author=' || adj || ' ' || noun || '}}</ref>' END"""

BIB_TEXT = """'* {{cite book |last=' || noun || ' |first=' || adj || ' |year=' || year || ' |title=' || title || ' |isbn=978-1-' || key9 || ' |publisher=Pub ' || brand || '}}'"""

LINE_HTML = """'<p>On <a href="/wiki/' || adj || '_' || noun || '" title="x">' || title || '</a> and <a href="/wiki/ISBN_(identifier)">ISBN</a> &amp; more<sup class="reference"><a href="#cite_note-k' || key || '">[' || ord || ']</a></sup>.</p>'"""
NOTE_HTML = """'<li id="cite_note-k' || key || '"><span class="reference-text">Book <a href="/wiki/Special:BookSources/978-0-' || key9 || '">isbn</a></span></li>'"""
SECTION_TITLE = "CASE WHEN o_orderstatus = 'P' THEN 'See also' ELSE 'Topic ' || section_id END"


# What LINES is worked out from: lines, and sections as rows of their own.
PIECES = """SELECT s.page_id, s.section_ord, s.section_id, l.l_linenumber AS ln, l.l_partkey AS key, l.l_suppkey AS supp, l.l_returnflag AS rf,
  p.p_name AS title, p.p_brand AS brand, p.p_size AS size, CAST(NULL AS STRING) AS stitle
FROM v_sections s JOIN lineitem l ON l.l_orderkey = s.section_id JOIN part p ON p.p_partkey = l.l_partkey"""
DERIVED = {
    "adj": "split_part(title, ' ', 1)", "noun": "split_part(title, ' ', 2)", "key9": "lpad(CAST(key AS STRING), 9, '0')",
    "year": "CAST(1990 + size % 20 AS STRING)", "host": "lower(replace(brand, '#', '-')) || '.example.org'",
}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, LINES, "v_sections")


def _joined(text: str, order: str, between: str, of: Column):
    pairs = F.array_sort(F.collect_list(F.when(of, F.struct(F.expr(order).alias("o"), F.expr(text).alias("t")))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), between)


def articles(spark: SparkSession, sf_dir: str, html: bool = True) -> DataFrame:
    """One article per customer that ordered anything: a lede, a section per
    further order, and a list of sources at the end. Without ``html`` the page is
    not rendered, for jobs that read the wiki text alone."""
    heads = sql_over(
        spark, sf_dir,
        f"SELECT page_id, section_ord, section_id, {SECTION_TITLE} AS stitle FROM v_sections JOIN orders ON o_orderkey = section_id",
        "v_sections",
    )
    # Rows are dealt by page while they are narrow: what follows is grouped by page or within it, and text is never dealt out.
    rows = sql_over(spark, sf_dir, PIECES, "v_sections").unionByName(heads, allowMissingColumns=True).repartition("page_id")
    is_line = F.col("stitle").isNull()
    place = F.row_number().over(Window.partitionBy("page_id", "section_ord", is_line).orderBy("ln", "key", "supp"))
    rows = rows.withColumn("ord", place).withColumns({name: F.expr(text) for name, text in DERIVED.items()})
    sections = rows.groupBy("page_id", "section_ord", "section_id").agg(
        F.max("stitle").alias("stitle"),
        _joined(CITE_TEXT, "ord", " ", is_line).alias("wt"),
        *([_joined(LINE_HTML, "ord", "", is_line).alias("ht")] if html else [F.lit("").alias("ht")]),
        F.array_sort(F.collect_list(F.expr(f"CASE WHEN ln = 4 AND rf <> 'R' THEN struct(ord, {BIB_TEXT} AS t) END"))).alias("bib"),
        *([F.collect_set(F.expr(NOTE_HTML)).alias("notes")] if html else [F.array().cast("array<string>").alias("notes")]),
        F.collect_set(F.expr("CASE WHEN ln = 2 THEN 'https://www.' || host || '/p/' || key END")).alias("links"),
    )
    level = F.when(F.col("section_ord") % 3 == 0, 2).otherwise(1)
    marks = F.when(F.col("section_ord") % 3 == 0, "===").otherwise("==")
    anchor = F.concat(F.lit("S_"), F.col("section_id"))
    is_lede = F.col("section_ord") == 1
    sections = sections.withColumns({
        "level": level,
        "anchor": anchor,
        "chunk": F.when(is_lede, F.concat(F.lit("Lede "), "wt", F.lit("\n"))).otherwise(
            F.concat(marks, F.lit(" "), "stitle", F.lit(" "), marks, F.lit("\n"), "wt", F.lit("\n"))
        ),
        "hchunk": F.when(is_lede, F.col("ht")).otherwise(
            F.concat(
                F.lit('<h2 id="'), anchor, F.lit('">'), "stitle", F.lit('</h2><div class="hatnote">See <a href="/wiki/Hat">hat</a></div>'), "ht"
            )
        ),
    })
    before = Window.partitionBy("page_id").orderBy("section_ord").rowsBetween(Window.unboundedPreceding, -1)
    sections = sections.withColumn("offset", F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)).cast("int"))
    pages = sections.groupBy("page_id").agg(
        F.array_sort(
            F.collect_list(F.struct("section_ord", "chunk", "hchunk", "level", "stitle", "anchor", "offset", "bib", "notes", "links"))
        ).alias("s"),
        F.sum(F.length("chunk")).cast("int").alias("len"),
    )

    def every(field: str):
        lists = F.transform(F.filter("s", lambda x: x[field].isNotNull()), lambda x: x[field])
        return F.flatten(lists)

    pages = pages.select(
        "page_id", "s", "len",
        F.array_join(F.transform(every("bib"), lambda x: x["t"]), "\n").alias("bib"),
        F.array_join(F.array_sort(F.array_distinct(every("notes"))), "").alias("notes"),
        F.array_sort(F.array_distinct(every("links"))).alias("links"),
    )
    infobox = """'<table class="infobox vcard"><tr><th>Artist</th><td><a href="/wiki/Mr_' || c_custkey || '">' || c_name || '</a><span style="display: none">hid<span>den</span>x</span></td></tr>'
      || '<tr><th>Inner</th><td><table><tr><th>a</th><td>b</td></tr></table></td></tr><tr><th colspan="2">Head only</th></tr>'
      || '<tr><th>Picture</th><td><img src="a.png"></td></tr><tr><th>Type &amp; kind</th><td>' || lower(c_mktsegment) || ' <a href="/wiki/File:A.png">f</a><a href="/wiki/Seg_' || c_mktsegment || '">s</a></td></tr></table>'"""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"), F.expr(infobox).alias("infobox"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Template:Taxonbar"), F.lit("Template:Cite")))
        .otherwise(F.array(F.lit("Template:Cite"))).alias("templates"),
        F.when(F.col("c_mktsegment") == "MACHINERY", '<div class="mw-kartographer">map</div>').otherwise("").alias("map"),
    )
    listed = F.struct(F.lit("99").alias("index"), F.lit(1).alias("level"), F.lit("Sources").alias("title"), F.lit("Sources").alias("anchor"), F.col("len").alias("offset"))
    body = F.transform(
        F.filter("s", lambda x: x["section_ord"] > 1),
        lambda x: F.struct(
            (x["section_ord"] - 1).cast("string").alias("index"), x["level"].alias("level"), x["stitle"].alias("title"),
            x["anchor"].alias("anchor"), x["offset"].alias("offset"),
        ),
    )
    done = (
        pages.join(customers, "page_id")
        .select(
            "page_id", "title",
            F.concat(
                "infobox", "map", F.array_join(F.transform("s", lambda x: x["hchunk"]), ""),
                F.lit('<h2 id="Sources">Sources</h2><ol class="references">'), "notes", F.lit("</ol>"),
            ).alias("html"),
            F.concat(
                F.array_join(F.transform("s", lambda x: x["chunk"]), ""), F.lit("== Sources ==\n"), "bib"
            ).alias("wikitext"),
            "templates",
            F.concat(
                "links", F.array(F.lit("https://web.archive.org/web/1"), F.lit("not a url"))
            ).alias("externallinks"),
            F.concat(body, F.array(listed)).alias("sections"),
        )
    )
    return done if html else done.drop("html")


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per order, its items as statements of three kinds."""
    claims = sql_over(
        spark, sf_dir, "SELECT c.*, l_linenumber, 0 AS x FROM v_claims c JOIN (SELECT DISTINCT l_linenumber FROM lineitem) ON property = 'P' || l_linenumber", "v_claims"
    )
    value = F.expr("""CASE WHEN l_linenumber <= 3 THEN '{"type":"wikibase-entityid","value":{"entity-type":"item","id":"Q' || value_id || '"}}'
      WHEN l_linenumber = 4 THEN '{"type":"globecoordinate","value":{"latitude":' || (value_id % 90) || '.5,"longitude":-' || (value_id % 180) || '.25}}'
      WHEN l_linenumber = 5 THEN '{"type":"time","value":{"time":"+' || (1900 + value_id % 100) || '-00-00T00:00:00Z"}}'
      WHEN l_linenumber = 6 THEN '{"type":"string","value":"id ' || value_id || '"}' ELSE NULL END""")
    statement = F.concat(
        F.lit('{"rank":"'), "rank", F.lit('","mainsnak":{'), F.coalesce(F.concat(F.lit('"datavalue":'), value), F.lit('"snaktype":"novalue"')),
        F.lit('},"qualifiers":{"P580":"'), "ord", F.lit('"},"references":['), F.when(F.col("ord") % 2 == 0, '"r1","r2"').otherwise(""), F.lit("]}"),
    )
    by_property = claims.groupBy("qid", "property").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", statement.alias("t")))), lambda x: x["t"]), ",").alias("st")
    )
    return by_property.groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "property", F.lit('":['), "st", F.lit("]")))), ",").alias("c")
    ).select(F.concat(F.lit('{"id":"Q'), "qid", F.lit('","claims":{'), "c", F.lit("}}")).alias("raw"))


def holding_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every part as a museum record; the size picks the partner's layout."""
    p = table(spark, sf_dir, "part").withColumns({
        "k": F.col("p_partkey").cast("string"), "pd": F.col("p_size") <= 25, "n": F.col("p_size") % 6,
        "img": F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("http://img.example/"), F.col("p_partkey").cast("string"))),
        "obj": F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("http://obj.example/"), F.col("p_partkey").cast("string"))),
    })

    def doc(partner: int, *cols) -> DataFrame:
        return p.filter(F.col("n") == partner).select(F.to_json(F.struct(*cols)).alias("raw"))

    met = doc(
        0, F.col("p_partkey").alias("objectID"), F.col("pd").alias("isPublicDomain"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("artistDisplayName"), F.lit("").alias("objectDate"), F.col("p_type").alias("medium"),
        F.coalesce("img", F.lit("")).alias("primaryImage"), F.array(F.lit("a"), F.lit("b")).alias("additionalImages"), F.col("obj").alias("objectURL"),
        F.lit("x").alias("unknownField"),
    )
    artic = doc(
        1,
        F.struct(F.col("p_partkey").alias("id"), F.col("pd").alias("is_public_domain"), F.when(F.col("img").isNotNull(), F.concat(F.lit("i"), "k")).alias("image_id"),
                 F.col("p_name").alias("title"), F.concat("p_brand", F.lit("\nDutch")).alias("artist_display"), F.col("p_type").alias("medium_display")).alias("data"),
        F.struct(F.lit("http://iiif.example/2").alias("iiif_url")).alias("config"),
    )
    cleveland = doc(
        2,
        F.struct(F.col("k").alias("accession_number"), F.when(F.col("pd"), "CC0").otherwise("Copyrighted").alias("share_license_status"), F.col("p_name").alias("title"),
                 F.array(F.struct(F.col("p_brand").alias("description"))).alias("creators"), F.col("p_type").alias("technique"),
                 F.struct(F.struct(F.col("img").alias("url")).alias("web")).alias("images"), F.col("obj").alias("url")).alias("data"),
    )
    getty = p.filter("n = 3").select(F.concat(
        F.lit('<html><script type="application/ld+json">'),
        F.to_json(F.struct(
            F.concat(F.lit("http://getty.example/object/"), "k", F.lit("/")).alias("url"), F.col("p_name").alias("name"),
            F.when(F.col("pd"), "https://creativecommons.org/publicdomain/zero/1.0/").otherwise("http://rightsstatements.org/vocab/InC/1.0/").alias("license"),
            F.array(F.struct(F.col("p_brand").alias("name"))).alias("creator"), F.col("p_type").alias("material"),
            F.concat("img", F.lit("/full/!300,300/0/default.jpg")).alias("thumbnailUrl"),
        )), F.lit("</script></html>"),
    ).alias("raw"))
    english = "array(named_struct('id', 'http://vocab.getty.edu/aat/300388277'))"
    rijks = doc(
        4, F.col("k").alias("id"),
        F.struct(F.expr(f"""array(
          named_struct('type', 'Name', 'content', 'Nederlands', 'language', array(named_struct('id', 'nl')), 'classified_as', CAST(NULL AS array<struct<id:string>>)),
          named_struct('type', 'Name', 'content', p_name, 'language', {english}, 'classified_as', CAST(NULL AS array<struct<id:string>>)),
          named_struct('type', 'Identifier', 'content', 'SK-' || k, 'language', CAST(NULL AS array<struct<id:string>>), 'classified_as', array(named_struct('id', 'http://vocab.getty.edu/aat/300312355'))))""").alias("identified_by")).alias("object"),
        F.struct(F.array(F.struct(F.array(F.struct(F.when(F.col("pd"), "https://creativecommons.org/publicdomain/mark/1.0/").otherwise("http://rightsstatements.org/vocab/InC/1.0/").alias("id"))).alias("classified_as"))).alias("subject_to")).alias("visual"),
        F.struct(F.array(F.struct(F.concat("img", F.lit("/full/max/0/default.jpg")).alias("id"))).alias("access_point")).alias("digital"),
    )
    iiif = p.filter("n = 5").select(
        F.to_json(F.struct(
            F.expr("named_struct('de', array('Titel'), 'en', array(p_name))").alias("label"),
            F.when(F.col("pd"), "http://creativecommons.org/publicdomain/mark/1.0/").otherwise("http://rightsstatements.org/vocab/InC/1.0/").alias("rights"),
            F.expr("IF(p_size > 12, array(named_struct('label', named_struct('en', array(p_type)))), array(named_struct('label', named_struct('en', array(p_type))), named_struct('label', named_struct('en', array('b')))))").alias("provider"),
            F.expr("array(named_struct('items', array(named_struct('items', array(named_struct('body', named_struct('service', array(named_struct('id', img)))))))))").alias("items"),
            F.expr("IF(obj IS NULL, NULL, array(named_struct('id', obj)))").alias("homepage"),
        )).alias("raw"),
        F.concat(F.lit("http://manifest.example/"), "k").alias("url"),
    )
    return {"met": met, "artic": artic, "cleveland": cleveland, "getty": getty, "rijks": rijks, "iiif": iiif}


def aggregator_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every part as a record of one of four aggregators."""
    p = table(spark, sf_dir, "part").withColumns({"k": F.col("p_partkey").cast("string"), "n": F.col("p_size") % 4})
    uri = "CASE WHEN p_size <= 20 THEN 'https://creativecommons.org/licenses/by-sa/4.0/' WHEN p_size <= 35 THEN 'http://rightsstatements.org/vocab/NoC-US/1.0/' ELSE 'free text' END"
    dpla = p.filter("n = 0").selectExpr(
        "to_json(map('id', k, 'object', 'http://t.example/' || k)) AS a",
        f"""to_json(named_struct('sourceResource.title', array(p_name, 'second'), 'sourceResource.subject.name', IF(p_size > 30, array(p_brand, p_type), NULL), 'dataProvider', named_struct('name', p_type), 'rights', array({uri}))) AS b""",
    )
    dpla = dpla.select(F.concat(F.regexp_replace("a", r"\}$", ","), F.regexp_replace("b", r"^\{", "")).alias("raw"))
    europeana = p.filter("n = 1").selectExpr(f"""to_json(named_struct('id', k, 'title', array(p_name), 'guid', 'http://e.example/' || k, 'dataProvider', array(p_type), 'rights', array({uri}), 'edmPreview', array('http://t.example/' || k))) AS raw""")
    digitalnz = p.filter("n = 2").selectExpr("""to_json(named_struct('id', k, 'title', p_name, 'content_partner', array(p_type), 'subject', array(p_brand, p_type),
      'usage', CASE WHEN p_size <= 20 THEN array('Share', 'Modify') WHEN p_size <= 35 THEN array('All rights reserved', 'Unknown') ELSE array('Unknown') END, 'thumbnail_url', 'http://t.example/' || k)) AS raw""")
    smithsonian = p.filter("n = 3").selectExpr("""to_json(named_struct('id', k, 'title', ' ' || p_name, 'url', 'u' || k, 'content', named_struct('descriptiveNonRepeating', named_struct('record_link', 'http://s.example/' || k, 'data_source', p_type,
      'online_media', named_struct('media', array(named_struct('type', 'Images', 'content', 'http://t.example/' || k, 'usage', named_struct('access', IF(p_size <= 20, 'CC0', 'Usage conditions apply')), 'resources', array(named_struct('name', ''))),
        named_struct('type', IF(p_size > 25, '3d_voyager', 'Sound'), 'content', 'doc', 'usage', named_struct('access', 'CC0'), 'resources', array(named_struct('name', 'Ape: ape: ' || p_type)))))),
      'indexedStructured', named_struct('scientific_name', array(p_name))))) AS raw""")
    return {"dpla": dpla, "europeana": europeana, "digitalnz": digitalnz, "smithsonian": smithsonian}


def bibliographic_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every part as a scan, a volume, an author's work, a paper and a notice."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string"))
    return {
        "archive": p.selectExpr("to_json(named_struct('identifier', 'doc' || k, 'title', p_name, 'creator', array(p_brand, 'x'), 'year', 1900 + p_size, 'isbn', IF(p_size > 10, array(k, 'alt' || k), NULL), 'licenseurl', IF(p_size > 25, 'http://creativecommons.org/licenses/by-nc/4.0/', NULL))) AS raw"),
        "volumes": p.selectExpr("""to_json(map('ISBN:' || k, named_struct('url', IF(p_size % 5 > 0, 'http://ol.example/' || k, NULL), 'ebooks',
          IF(p_size > 30, array(named_struct('availability', IF(p_size > 40, 'full', 'borrow'), 'read_url', IF(p_size > 45, 'http://read.example/' || k, NULL), 'preview_url', 'http://pre.example/' || k)), NULL)))) AS raw"""),
        "author_works": p.selectExpr("to_json(named_struct('key', '/works/' || k, 'title', p_name, 'ebook_access', IF(p_size > 25, 'borrowable', 'no_ebook'), 'cover_i', p_size - 10, 'ia', array('scan' || k), 'author_key', IF(p_size > 20, array(p_brand, p_type), array(p_brand)), 'edition_count', p_size)) AS raw"),
        "papers": p.selectExpr("""to_json(named_struct('id', 'W' || k, 'doi', 'https://doi.org/10.1/' || k, 'ids', named_struct('pmid', 'https://pubmed.example/' || k), 'title', p_name, 'publication_year', 1950 + p_size,
          'open_access', named_struct('is_oa', p_size > 20, 'oa_url', IF(p_size > 25, 'http://oa.example/' || k, NULL), 'oa_status', p_type), 'authorships', array(named_struct('author', named_struct('display_name', p_brand, 'orcid', p_type))),
          'best_oa_location', named_struct('license', IF(p_size > 40, 'cc-by-nc', 'other-oa')), 'cited_by_count', p_size, 'is_retracted', p_size = 50)) AS raw"""),
        "notices": p.selectExpr("""to_json(named_struct('message', named_struct('DOI', '10.1/' || k, 'updated-by', IF(p_size > 45, array(named_struct('type', 'retraction', 'source', 'retraction-watch', 'DOI', '10.2/' || k)), NULL),
          'update-to', IF(p_size < 3, array(named_struct('type', 'correction', 'source', 'publisher', 'DOI', '10.3/' || k)), NULL)))) AS raw"""),
    }


def taxon_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string"))
    photo = "named_struct('license_code', {}, 'medium_url', 'http://photo.example/{}/' || k, 'attribution', 'by ' || p_brand)"
    return {
        "inaturalist": p.filter("p_size <= 25").selectExpr(f"""to_json(named_struct('id', k, 'name', p_name, 'preferred_common_name', IF(p_size > 10, p_type, NULL), 'observations_count', p_size,
          'default_photo', {photo.format("IF(p_size > 20, NULL, 'cc-by-nc')", 'a')}, 'taxon_photos', IF(p_size > 5, array(named_struct('photo', {photo.format("'cc-by'", 'b')})), NULL))) AS raw"""),
        "gbif": p.filter("p_size > 25").selectExpr("to_json(named_struct('key', k, 'scientificName', p_name || ' L.', 'canonicalName', IF(p_size > 40, p_name, NULL))) AS raw"),
    }


def authority_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One authority per part: a heading, then a plain and a tagged variant."""
    pref, alt = "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel"
    return table(spark, sf_dir, "part").selectExpr(
        "IF(p_size > 25, 'sh', 'n') || p_partkey AS id",
        f"""'[{{"@id":"http://id.loc.gov/authorities/' || IF(p_size > 25, 'subjects', 'names') || '/' || IF(p_size > 25, 'sh', 'n') || p_partkey || '"' ||
          IF(p_size > 3, ',"{pref}":[{{"@value":"' || p_name || '"}}]', '') || ',"{alt}":["' || p_brand || '",{{"@value":"' || p_type || '"}}]}},{{"@id":"other"}}]' AS raw""",
    )


def graph_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts as items, who supplies what as connections."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "to_json(named_struct('id', 'p' || p_partkey, 'source', p_brand, 'title', p_name, 'identifiers', IF(p_size > 25, map('wikidata', 'Q' || p_partkey), NULL), 'potential', map('total', p_size))) AS raw"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr("to_json(named_struct('id', 's' || s_suppkey, 'source', 'supplier', 'title', s_name)) AS raw")
    edges = sql_over(spark, sf_dir, "SELECT src, dst, type, sort_array(collect_set(system)) AS via FROM v_edges GROUP BY src, dst, type", "v_edges")
    connections = edges.groupBy("src").agg(
        F.collect_list(F.struct(F.col("dst").alias("targetId"), "type", F.lit("supplies").alias("label"), F.col("via").alias("linkedVia"))).alias("out")
    ).select(F.to_json(F.create_map("src", "out")).alias("raw"))
    return parts.unionByName(suppliers), connections
