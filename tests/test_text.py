"""Column expressions and extraction on small hand-made cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import identifiers as I
from marginalia.functions import licences as L
from marginalia.functions import markup as MK
from marginalia.functions import places as P
from marginalia.functions import text as T
from marginalia.operators import extract as X
from marginalia.plans import corpus


def value(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("fn,given,want", [
    (T.name_tokens, "Les Années-Müllers of Bus", ["les", "annee", "muller", "of", "bus"]),
    (T.name_tokens, "Straße ø2", ["stra", "e", "2"]),
    (T.institution_tokens, "The Universities of Göttingen", ["universitie", "gottingen"]),
    (T.title_tokens, "The History of an Ox in 1998", ["history", "1998"]),
    (T.score_tokens, "The Plates of 1998 plate", ["plate"]),
    (T.folded_title, "The Ring!", "ring"),
    (T.folded_title, "The", "the"),
    (T.canonical_title, "red_ring of_x", "Red ring of x"),
    (T.readable_date, "+1899-05-04T00:00:00Z", "4 May 1899"),
    (T.readable_date, "+1899-00-00T00:00:00Z", "1899"),
    (T.readable_date, "circa 1750", "1750"),
    (I.valid_isbn, "978-0-306-40615-7", "9780306406157"),
    (I.valid_isbn, "978-0-12", None),
    (I.isbn_digits, "0-8044-2957-x", "080442957X"),
    (I.norm_doi, "https://doi.org/10.1/AbC", "10.1/abc"),
    (I.host_of, "https://WWW.Example.org/x", "example.org"),
    (I.host_of, "not a url", None),
    (I.clean_query, "//h.example/a.png?utm_source=x&amp;w=2", "https://h.example/a.png?w=2"),
    (I.clean_query, "https://h.example/a.png?utm_source=x", "https://h.example/a.png"),
    (MK.strip_tags, "a<!-- <b>x</b> -->b<i>c</i><!-- open", "abc"),
    (MK.decode_entities, "a&#8217;s&#x41;&nbsp;&amp;lt;[12]", "a’sA <"),
    (MK.strip_markup, "'''[[Target|Label]]''' and [[Plain]]<br/>", "Label and Plain"),
    (L.code_from_uri, "http://creativecommons.org/licenses/by-nc-sa/2.0/", "CC BY-NC-SA"),
    (L.code_from_uri, "https://creativecommons.org/licenses/nd/1.0/", None),
    (L.code_from_uri, "http://rightsstatements.org/vocab/InC-EDU/1.0/", "INC"),
    (L.code_from_slug, "CC-BY-SA", "CC BY-SA"),
    (L.code_from_slug, "other-oa", None),
    (L.code_from_label, "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC"),
    (L.code_from_label, "CC0", None),
    (L.code_from_label, "Creative Commons Attribution-Share Alike 3.0 Unported", "CC BY-SA"),
    (L.code_from_label, "CC attribution, non-commercial, no derivatives", "CC BY-NC-ND"),
    (L.code_from_label, "creativecommons zero with attribution", "CC0"),
    (L.code_from_label, "Creative Commons Public Domain Mark 1.0", "PDM"),
    (L.code_from_label, "Creative Commons NonCommercial", None),
    (L.code_from_label, "Attribution-ShareAlike", None),
    (L.code_from_label, "", None),
    (L.jurisdiction_code, "countries with 50 years pma or shorter", "PMA-50-OR-LESS"),
    (L.jurisdiction_code, "countries with 70 years pma", "PMA-70"),
    (L.jurisdiction_code, "Netherlands", "Netherlands"),
])
def test_expression(spark, fn, given, want):
    assert value(spark, fn, given) == want


def test_points_and_tiles(spark):
    assert value(spark, P.earth_point, "<http://x/Q405> Point(1 2)") is None
    got = value(spark, P.earth_point, "Point(-0.5 51.25)")
    assert (got.lon, got.lat) == (-0.5, 51.25)
    tile = spark.range(1).select(P.tile(F.lit(51.5), F.lit(-0.12), 8).alias("t")).first().t
    assert (tile.z, tile.x, tile.y) == (8, 127, 85)


def test_name_match(spark):
    df = spark.createDataFrame(
        [("Prandtl, Ludwig", "Ludwig Prandtl"), ("Prandtl, L.", "Ludwig Prandtl"), ("Prandtl", "Ludwig Prandtl"), ("Doe, Jane", "Mary Jane Doe")],
        "c string, p string",
    )
    assert [r.v for r in df.select(T.name_matches(F.col("c"), F.col("p")).alias("v")).collect()] == [True, False, False, True]


def test_unknown_licence_stays_unknown(spark):
    assert value(spark, L.code_from_uri, "https://example.org/terms") is None
    assert value(spark, L.code_from_slug, None) is None


WIKITEXT = """Text<ref name="a" />. More <ref name="b">{{cite book |title=[[A|B {{x|y|{{z}}}}]] |title=Last wins
 |isbn=0-306-40615-2 |last=Roe |first=R. |last2=Doe}}</ref> and <ref>no template</ref>
<REF>{{Citation|title=T |doi=10.48550/ARXIV.2101.00001}}</REF> <ref>{{reflist}} {{cite web|url=u}}</ref>
{{sfn|Roe|Doe|1998a|p=2}} {{harv|1999}} {{sfn|Poe|no year}} {{ harvnb | Roe | 1998 | 2001 }}"""


def sections(spark, text=WIKITEXT):
    return spark.createDataFrame([(1, 1, text)], "page_id long, section_ord long, wikitext string")


def test_citations(spark):
    rows = X.citations(sections(spark)).orderBy("ord").collect()
    assert [(r.kind, r.title, r.isbn, r.author) for r in rows] == [
        ("book", "Last wins", "0306406152", "R. Roe & Doe"), ("generic", "T", None, None),
    ]


def test_scholarly_and_identified(spark):
    assert [(r.doi, r.arxiv) for r in X.scholarly_cites(sections(spark)).collect()] == [(None, "2101.00001")]
    assert [(r.isbn, r.title) for r in X.identified_cites(sections(spark)).collect()] == [("0306406152", "Last wins")]


def test_short_cites_take_the_last_year(spark):
    rows = X.short_cites(sections(spark)).orderBy("ord").collect()
    assert [(r.surnames, r.year, r.key) for r in rows] == [
        (["roe", "doe"], "1998a", "roe|1998a"), (["roe", "1998"], "2001", "roe|2001"),
    ]


BIB = """* {{cite book|last=Roe|year=1998|title=First|isbn=978-0-306-40615-7}}
* {{cite book|last=Roe|date=May 1998|title=Second|oclc=5|ref={{sfnref|Custom|1999}}}}
* {{cite book|last=Poe|year=2000|title=No number}} <ref>{{cite book|last=Ref|year=1990|oclc=7}}</ref>"""


def test_bibliography(spark):
    got = {r.key: (r.title, r.isbn, r.oclc) for r in X.bibliography(sections(spark, BIB)).collect()}
    assert got == {
        "roe|1998": ("First", "9780306406157", None), "custom|1999": ("Second", None, "5"),
    }


def test_slice_sections_boundaries(spark):
    text = "Lede\n==A==\na\n===B===\nb\n==C==\nc\n"
    marks = [("1", 1, "A", "A", 5), ("2", 2, "B", "B", 13), ("T-1", 1, "T", "T", None), ("3", 1, "C", "C", 23)]
    df = spark.createDataFrame(
        [(1, "Page", text, marks)],
        "page_id long, title string, wikitext string, sections array<struct<index:string,level:int,title:string,anchor:string,offset:int>>",
    )
    own = {r.title: r.wikitext for r in X.slice_sections(df).collect()}
    assert own == {"Page": "Lede", "A": "==A==\na\n===B===\nb", "B": "===B===\nb", "T": None, "C": "==C==\nc"}
    assert {r.title: r.wikitext for r in X.slice_sections(df, stop_at=2).collect()}["A"] == "==A==\na"


INFOBOX = """<p>x</p><table class="infobox"><tr><th>A&amp;B</th><td>v<span style="color:red;display : none">h<span>i</span>j</span> w</td></tr>
<tr><th>Skip</th><td> <img src="x"> </td></tr><tr><td>no head</td></tr>
<tr><th>C</th><td><table><tr><th>in</th><td>ner</td></tr></table>c <a href="/wiki/File:x">f</a><a href="/wiki/Caf%C3%A9_au_lait">l</a></td></tr></table><table><tr><th>Out</th><td>side</td></tr></table>"""


def test_infobox(spark):
    df = spark.createDataFrame([(1, INFOBOX), (2, "<p>none</p>"), (3, '<table class="infobox"><tr><th>U</th><td>open</td></tr>')], "page_id long, html string")
    rows = [(r.page_id, r.label, r.value) for r in X.infobox_rows(df).orderBy("page_id", "ord").collect()]
    assert rows == [(1, "A&B", "v w"), (1, "C", "c fl"), (3, "U", "open")]
    assert [(r.page_id, r.title) for r in X.infobox_links(df).collect()] == [(1, "Café au lait")]


def test_blocks_drop_tables_and_short_ones(spark):
    html = '<p class="a">One<sup>[1]</sup> <b>two</b></p><p>x</p><table><tr><td><p>no</p></td></tr></table><h3>Head</h3><pre>p</pre>'
    df = spark.createDataFrame([(1, 1, html)], "page_id long, section_ord long, html string")
    blocks, prose = X.text_blocks(df)
    assert [(b.kind, b.text) for b in blocks.orderBy("ord").collect()] == [("p", "One two"), ("h", "Head")]
    assert prose.first().prose_chars == 11


def test_long_markup_does_not_overflow(spark):
    text = "<ref>{{cite book |title=" + "x " * 60_000 + "|isbn=0306406152 " + "{{n|a}}" * 3_000 + "}}</ref>"
    row = X.citations(sections(spark, text)).first()
    assert row.isbn.startswith("0306406152")


def test_prose_links_cap_and_jargon(spark):
    html = "".join(f'<a href="/wiki/T_{i}">x</a>' for i in range(30)) + '<a href="/wiki/T_1">again</a><a href="/wiki/100%">bad</a>'
    df = spark.createDataFrame([(1, 1, '<a href="/wiki/OCLC">o</a>' + html)], "page_id long, section_ord long, html string")
    rows = X.prose_links(df, cap=24).orderBy("ord").collect()
    assert [r.title for r in rows] == [f"T {i}" for i in range(24)]
    rows = X.prose_links(df).orderBy("ord").collect()
    assert [r.title for r in rows] == [f"T {i}" for i in range(30)]


# --- nesting of any depth, markup left open ------------------------------------------


def _cites(spark, wikitext):
    from marginalia.operators.extract import citations

    df = spark.createDataFrame([(1, 1, wikitext)], "page_id long, section_ord long, wikitext string")
    return [(r.ord, r.kind, r.title, r.isbn) for r in citations(df).orderBy("ord").collect()]


def test_citations_at_any_depth_and_with_open_links(spark):
    deep = "{{a|" * 10 + "x" + "}}" * 10
    assert _cites(spark, f"<ref>{{{{cite book|title={deep}|isbn=1234567890}}}}</ref>")[0][3] == "1234567890"
    kept = _cites(spark, "<ref>{{cite book|title=[[A|isbn=1234567890}}</ref>")
    assert len(kept) == 1 and kept[0][3] is None
    assert _cites(spark, "<ref>{{note {{cite book|title=B}}</ref>") == []
    assert _cites(spark, "<ref>{{cite web|title=A\u0001\u0002B}}</ref><ref>open {{cite web|title=C}}") == [(1, "web", "AB", None)]


def test_bibliography_reads_nested_entries(spark):
    from marginalia.operators.extract import bibliography

    text = "{{refbegin|{{cite book|last=Roe|year=1999|isbn=9780306406157|title={{a|{{b|{{c|{{d|{{e|x}}}}}}}}}} }}}} {{cite book|last=Open|year=2001"
    df = spark.createDataFrame([(1, 2, text)], "page_id long, section_ord long, wikitext string")
    assert [r.isbn for r in bibliography(df).collect()] == ["9780306406157"]


def test_infobox_at_any_depth(spark):
    from marginalia.operators.extract import infobox_links, infobox_rows

    inner = "<table><tr><th>no</th><td>x</td></tr>" * 7 + "</table>" * 7
    shown = '<span style="display: none">' + "<span>h</span>" * 6 + "</span>"
    html = (
        f'<table class="infobox"><tr><th>Born</th><td>1900{shown}</td></tr>{inner}<tr><th>Place</th>'
        '<td><a href="/wiki/Rome">Rome</a></td></tr></table><a href="/wiki/Out">out</a>'
    )
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.label, r.value) for r in infobox_rows(df).orderBy("ord").collect()] == [("Born", "1900"), ("Place", "Rome")]
    assert [r.title for r in infobox_links(df).collect()] == ["Rome"]


def test_blocks_with_markup_left_open(spark):
    from marginalia.operators.extract import prose_links, text_blocks

    html = (
        "<p>One <table>gone</table> two.</p><table>cut <table> deep</table><h3>Head</h3><div class=\"x hatnote\">off</div>"
        '<p>See <a href="/wiki/A">A</a><sup>1</sup></p><p>open <a href="/wiki/B">B</a><table><p'
    )
    df = spark.createDataFrame([(1, 1, html)], "page_id long, section_ord long, html string")
    blocks, _ = text_blocks(df)
    assert [(r.kind, r.text) for r in blocks.orderBy("ord").collect()] == [("p", "One two."), ("h", "Head"), ("p", "See A")]
    assert [r.title for r in prose_links(df).orderBy("ord").collect()] == ["A", "B"]


def test_open_markup_costs_linear_time(spark):
    import time

    from marginalia.operators.extract import citations, infobox_rows, prose_links, text_blocks

    def took(n, unit):
        df = spark.createDataFrame(
            [(1, 1, unit * n, unit * n)], "page_id long, section_ord long, html string, wikitext string"
        )
        began = time.perf_counter()
        text_blocks(df)[0].count(), prose_links(df).count(), infobox_rows(df).count(), citations(df).count()
        return time.perf_counter() - began

    for unit in ('<div class="hatnote">', "<table ", '<span class="geo" ', "<p>", "<ref>{{cite book|"):
        took(100, unit)
        assert took(16_000, unit) < 8 * took(4_000, unit) + 2


# --- manifests nested to any depth --------------------------------------------------


def test_manifest_text_at_any_depth(spark):
    from marginalia.sources.readers import manifest_text

    deep = "A title"
    for k in range(12):
        deep = [deep, "other"] if k % 3 == 0 else {"@value": deep} if k % 3 == 1 else {"de": "zwei", "en": deep}
    cases = {
        json.dumps(deep): "A title", "plain": "plain", '{"none":["x"]}': "x", '{"fr":["y"],"de":["z"]}': "z", '[{"@value":"<b>bold</b> v"}]': "bold v",
        '{"broken": ': None, "[": None, "{}": None, "[]": None, '{"en": null, "none": "n"}': "n", '["  "]': None, '{"en":[[["n"]]]}': "n", '[3]': "3",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for r in df.select("raw", "want", manifest_text(df.raw).alias("got")).collect():
        assert r.got == r.want, r.raw


def test_footnotes_of_every_marker(spark):
    """Also of the lines whose key ends in 5."""
    from compare import compare

    from marginalia.plans import load_catalog

    queries, sql = load_catalog()
    diff, rows, _ = compare(spark, "footnotes", queries["footnotes"], sql["footnotes"], "/root/testdata/sf0.001")
    assert diff is None and rows > 0


@pytest.mark.parametrize("nest", [
    lambda t: MK.cut_runs(t, "<b", "</b>"), lambda t: MK.up_to_last(t, "</b>"), MK.strip_markup,
    lambda t: MK.cut_balanced(t, MK.OPEN_T, MK.CLOSE_T), lambda t: MK.first_balanced(t, MK.OPEN_T, MK.CLOSE_T), X.infobox_block,
])
def test_nested_expressions_hold_their_text_once(spark, nest):
    """Six around one another read the column once, not 2 to the 6 times."""
    text = F.col("t")
    for _ in range(6):
        text = nest(text)
    plan = spark.createDataFrame([("x",)], "t string").select(text.alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("t#") <= 2  # in the expression, and as the input's column


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_behind_a_parse_do_not_parse_again(spark):
    wt = "<ref>{{cite journal|doi=10.1/a|title=T|DOI=10.1/b}}</ref><ref>{{cite book|isbn=978-0-306-40615-7|last=L|year=1999|title=[[B|C]] {{x|y}}}}</ref>"
    df = spark.createDataFrame([(1, 1, wt)], "page_id long, section_ord long, wikitext string")
    papers, books = X.scholarly_cites(df), X.identified_cites(df)
    listed = X.bibliography(df.withColumn("wikitext", F.regexp_replace("wikitext", "</?ref>", "")))
    for found in (papers, books, listed):
        assert _plan(found).count("map_from_entries(") == 1
    assert [(r.ord, r.doi, r.title) for r in papers.collect()] == [(1, "10.1/b", "T")]
    assert [(r.ord, r.isbn) for r in books.collect()] == [(2, "9780306406157")]
    assert [r.title for r in listed.collect()] == ["C {{x|y}}"]


def test_flat_and_nested_templates_are_cut_alike(spark):
    texts = ["{{a|b=1||c}}", "{{|b=1}}", "{{a}}", "{{a|b={{c|d=2}}|e=[[f|g]]}}", "{{a|}}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(MK.mark_nesting(F.col("t")).alias("t"))
    parts = [r[0] for r in df.select(F.transform(MK.template_parts(F.col("t")), MK.unmark_nesting)).collect()]
    assert parts == [["a", "b=1", "", "c"], [" ", "b=1"], ["a"], ["a", "b={{c|d=2}}", "e=[[f|g]]"], ["a", ""]]
    last = spark.range(1).select(MK.up_to_last(F.lit("a</REF>b\n</ref>c<ref>"), r"(?i)</ref>"), MK.up_to_last(F.lit("none"), r"(?i)</ref>")).first()
    assert tuple(last) == ("a</REF>b\n</ref>", "")


def test_a_licence_name_is_read_once(spark):
    from marginalia.operators import rights as R

    rows = [("a", 1, "Creative Commons CC0 License"), ("a", 2, "no licence"), ("b", 1, "no licence"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "item string, ord long, licence_label string").selectExpr(
        "*", "IF(item = 'b', 'Q19652', NULL) AS status", *[f"CAST(NULL AS STRING) AS {c}" for c in ("jurisdiction", "how", "creator", "creator_status", "self_status")]
    )
    out = R.rights_record(df)
    # Each reading looks its words up among the terms, run by run.
    assert _plan(out).count("creativecommons") == 1
    assert {r.item: r.licences and [x.licence for x in r.licences] for r in out.collect()} == {"a": ["CC0"], "b": None}


def test_text_of_articles_is_not_dealt_out(spark):
    """What an exchange moves has no text yet: none stands above the grouping that writes it."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = corpus.articles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    plan = [x for x in text.split("\n") if re.match(r"[ :]*[+:]- ", x)]  # others are lines of a literal
    depth = [re.match(r"[ :]*[+:]- ", x).end() for x in plan]
    assert any("collect_list" in x for x in plan)
    for k, line in enumerate(plan):
        if "Exchange " in line:
            below = next((j for j in range(k + 1, len(plan)) if depth[j] <= depth[k]), len(plan))
            assert not any("collect_list" in x for x in plan[k + 1 : below]), line
