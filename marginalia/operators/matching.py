"""Joins that resolve citations, entities and records to one another."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.identifiers import (
    blank_to_null,
    host_of,
    host_suffixes,
    norm_doi,
)
from marginalia.functions.markup import let
from marginalia.functions.ordering import ordered_ranges, top_k
from marginalia.functions.places import earth_point, map_feature, tile
from marginalia.functions.text import (
    canonical_title,
    fold,
    name_matches,
    name_tokens,
    norm_title,
    same_institution,
    title_tokens,
    year_of,
)
from marginalia.operators.graph import descendants
from marginalia.operators.ranking import best_rank_values
from marginalia.session import deal


def resolve_titles(titles: DataFrame, redirects: DataFrame, page_props: DataFrame) -> DataFrame:
    """Titles to entity ids; a redirected title takes its target's id."""
    asked = titles.select(canonical_title(F.col("title")).alias("title")).distinct()
    moved = redirects.select(
        canonical_title(F.col("from")).alias("title"), canonical_title(F.col("to")).alias("_to")
    ).distinct()
    props = page_props.select(canonical_title(F.col("title")).alias("_title"), "qid").distinct()
    return (
        asked.join(moved, "title", "left")
        .withColumn("_title", F.coalesce("_to", "title"))
        .join(props, "_title", "left")
        .select("title", "qid")
    )


def gate_failures(holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First reason to refuse each holding record (null: it passes), and the
    counts per partner, host and reason with subtotals."""
    several = (F.col("partner") == "iiif") & (F.coalesce("providers", F.lit(0)) > 1)
    reason = (
        F.when(F.col("id").isNull(), "no-record")
        .when(blank_to_null(F.col("institution")).isNull() & several, "several-institutions")
        .when(blank_to_null(F.col("institution")).isNull(), "no-institution")
        .when(~F.coalesce("public_domain", F.lit(False)), "non-pd-rights")
        .when(blank_to_null(F.col("image_url")).isNull(), "no-image")
        .when(blank_to_null(F.col("href")).isNull(), "no-object-page")
    )
    rows = holdings.withColumn("reason", reason)
    counts = (
        rows.select("partner", host_of(F.col("href")).alias("host"), "reason")
        .rollup("partner", "host", "reason")
        .agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grouping"))
    )
    return rows, counts


def mappable(statements: DataFrame) -> DataFrame:
    """Anchors that are places and not defunct, with their map feature, point
    and tile. A point on another globe gives no tile."""
    kept = statements.filter(F.col("place") & ~F.coalesce("defunct", F.lit(False)))
    return (
        kept.withColumn("feature", map_feature(F.col("osmw"), F.col("osmn"), F.col("osmr")))
        .withColumn("point", earth_point(F.col("coord")))
        .withColumn("tile", F.when(F.col("point").isNotNull(), tile(F.col("point.lat"), F.col("point.lon"))))
    )


def split_broad(hits: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    """Shelves and notes: a heading with too many hits becomes a note, unless
    it is the article's own subject."""
    broad = (F.col("total") > above) & ~F.coalesce("is_subject", F.lit(False))
    return hits.filter(~broad), hits.filter(broad)


_NEEDS = {
    "rights": ("met", "aic", "rijks", "cleveland", "getty", "iiif"),
    "place": ("coord", "osmr", "osmw", "osmn"),
}


def eligible_keys(
    statements: DataFrame, claims: DataFrame, need: str, person: str = "Q5", class_property: str = "P31"
) -> DataFrame:
    """Entities worth a rights or place lookup (some variable is stated), or
    an artworks lookup (the entity is a person)."""
    if need == "artworks":
        people = claims.filter((F.col("property") == class_property) & (F.col("value_id") == person))
        return statements.select("qid").join(people.select("qid"), "qid", "left_semi").distinct()
    stated = [F.col(c).cast("string") for c in _NEEDS[need] if c in statements.columns]
    return statements.filter(F.coalesce(*stated, F.lit(None)).isNotNull()).select("qid").distinct()


def partner_statements(
    claims: DataFrame,
    anchors: DataFrame,
    registry: DataFrame,
    variables: Sequence[str],
    museums: DataFrame | None = None,
) -> DataFrame:
    """One wide row per anchor: the least value of every variable its claims
    state. ``registry``: property, var. With ``museums`` (museum, name) the
    inventory number counts only if the stated museum is in that group; it
    becomes ``si``, the museum's name ``si_name``."""
    mine = claims.join(anchors.select("qid").distinct(), "qid", "left_semi")
    named = mine.join(registry, "property")
    value = F.col("value")
    wide = [F.min(F.when(F.col("var") == v, value)).alias(v) for v in variables]
    if museums is None:
        return named.groupBy("qid").agg(*wide)
    named = named.join(
        museums, (F.col("var") == "sicoll") & (value == F.col("museum")), "left"
    )
    out = named.groupBy("qid").agg(
        *wide, F.min(F.when(F.col("name").isNotNull(), F.struct("museum", "name"))).alias("_museum")
    )
    return (
        out.withColumn("si", F.when(F.col("_museum").isNotNull(), F.col("siinv")))
        .withColumn("si_name", F.when(F.col("si").isNotNull(), F.col("_museum.name")))
        .drop("_museum")
    )


def resolve_short_cites(pointers: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Pointers joined to the page's bibliography; each key once per section,
    where it first stands; a pointer that leads nowhere is dropped."""
    first = pointers.groupBy("page_id", "section_ord", "key").agg(F.min("ord").alias("ord"))
    return first.join(bibliography, ["page_id", "key"])


def match_archive_docs(cites: DataFrame, docs: DataFrame, least: float = 0.34) -> DataFrame:
    """Scanned text for each citation. By ISBN: the document shares it and
    holds at least ``least`` of the cited title's words, best share first. By
    LCCN or OCLC: the first document, marked as unverified.

    ``cites``: cite_id, isbn, lccn, oclc, title; ``docs``: doc_id, ord, title,
    isbns, lccn, oclc. Copies are reduced before the join: citations to
    distinct (isbn, title), documents to distinct (isbn, title)."""
    asked = cites.filter("isbn IS NOT NULL").select("isbn", "title").distinct()
    held = (
        docs.select(F.explode(F.array_distinct("isbns")).alias("isbn"), F.col("title").alias("doc_title"), "ord", "doc_id")
        .groupBy("isbn", "doc_title")
        .agg(F.min(F.struct("ord", "doc_id")).alias("d"))
        .select("isbn", "doc_title", "d.ord", "d.doc_id")
    )
    wanted = title_tokens(F.col("title"))
    share = F.try_divide(
        F.size(F.array_intersect(title_tokens(F.col("doc_title")), wanted)), F.size(wanted)
    )
    scored = asked.join(held, "isbn").withColumn("score", share).filter(F.col("score") >= least)
    best = top_k(scored, ["isbn", "title"], [F.desc("score"), "ord"]).select(
        F.col("isbn").alias("_isbn"), F.col("title").alias("_title"), "doc_id", "score"
    )
    by_isbn = cites.join(
        best, (F.col("isbn") == F.col("_isbn")) & F.col("title").eqNullSafe(F.col("_title"))
    ).select(*cites.columns, "doc_id", "score", F.lit("isbn").alias("via"), F.lit("identifier").alias("evidence"))

    def first_doc(key: str, rest: DataFrame) -> DataFrame:
        first = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.min(F.struct("ord", "doc_id")).alias("d")
        )
        return rest.join(first, key).select(
            *cites.columns, F.col("d.doc_id"), F.lit(None).cast("double").alias("score"),
            F.lit(key).alias("via"), F.lit("identifier-unverified").alias("evidence"),
        )

    bare = cites.filter("isbn IS NULL")
    by_lccn = first_doc("lccn", bare.filter("lccn IS NOT NULL"))
    by_oclc = first_doc("oclc", bare.filter("lccn IS NULL AND oclc IS NOT NULL"))
    return by_isbn.unionByName(by_lccn).unionByName(by_oclc)


def citation_access(cites: DataFrame, volumes: DataFrame, failed: DataFrame) -> DataFrame:
    """How each cited book can be read: full, borrow, catalog, or nothing
    found; unchecked when its lookup failed and no answer came otherwise."""
    # Cites without an ISBN match nothing; dealt by it alone, all of them would go to one task. A struct, since Spark
    # takes a constant column out of the keys.
    spread = F.when(F.col("isbn").isNull(), F.xxhash64(*cites.columns)).otherwise(F.lit(0).cast("bigint"))
    one = F.struct("isbn", F.lit(0).cast("bigint").alias("spread")).alias("_key")
    known = volumes.filter("isbn IS NOT NULL").groupBy("isbn").agg(F.min(F.struct("ord", "availability")).alias("v")).select(
        one, F.col("v.availability").alias("access")
    )
    lost = failed.filter("isbn IS NOT NULL").select("isbn").distinct().select(one, F.lit(True).alias("_failed"))
    return (
        cites.withColumn("_key", F.struct("isbn", spread.alias("spread")))
        .join(known, "_key", "left")
        .join(lost, "_key", "left")
        .withColumn(
            "unchecked",
            F.col("isbn").isNotNull() & F.col("access").isNull() & F.coalesce("_failed", F.lit(False)),
        )
        .select(*cites.columns, "access", "unchecked")
    )


def match_papers(papers: DataFrame, works: DataFrame) -> DataFrame:
    """Cited papers to catalogue works: an arXiv id needs no lookup and is
    open; else by normal DOI; else by PMID. Works that are neither open nor
    retracted (with a DOI to point at) give nothing.

    ``papers``: paper_id, doi, pmid, arxiv; ``works``: work_id, ord, doi, pmid,
    is_oa, oa_url, licence, is_retracted."""
    columns = ["paper_id", "work_id", "via", "href", "licence", "retracted", "no_free_copy"]
    arxiv = papers.filter("arxiv IS NOT NULL").select(
        "paper_id",
        F.lit(None).cast(works.schema["work_id"].dataType).alias("work_id"),
        F.lit("arxiv").alias("via"),
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv").alias("href"),
        F.lit(None).cast("string").alias("licence"),
        F.lit(False).alias("retracted"),
        F.lit(False).alias("no_free_copy"),
    )
    is_open = F.coalesce(F.col("is_oa") & F.col("oa_url").isNotNull(), F.lit(False))
    retracted = F.coalesce("is_retracted", F.lit(False))
    usable = works.withColumn("_doi", norm_doi(F.col("doi")))

    def by(key: str, wanted: DataFrame, via: str) -> DataFrame:
        # the first work per key, chosen before the join
        first = usable.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
            F.min(F.struct("ord", "work_id", "doi", "is_oa", "oa_url", "licence", "is_retracted")).alias("w")
        )
        return (
            wanted.join(first, "_key")
            .select("paper_id", "w.*")
            .filter(is_open | (retracted & F.col("doi").isNotNull()))
            .select(
                "paper_id", "work_id", F.lit(via).alias("via"),
                F.when(is_open, F.col("oa_url")).otherwise(F.col("doi")).alias("href"),
                "licence", retracted.alias("retracted"), (~is_open).alias("no_free_copy"),
            )
        )

    rest = papers.filter("arxiv IS NULL")
    dois = by("_doi", rest.filter("doi IS NOT NULL").withColumn("_key", norm_doi(F.col("doi"))), "doi")
    pmids = by("pmid", rest.filter("doi IS NULL AND pmid IS NOT NULL").withColumn("_key", F.col("pmid")), "pmid")
    return arxiv.select(*columns).unionByName(dois.select(*columns)).unionByName(pmids.select(*columns))


def confirm_retractions(
    works: DataFrame, updated_by: DataFrame, update_to: DataFrame, watch: str = "retraction-watch"
) -> DataFrame:
    """A retraction stands if the work lists a notice from the watch source
    and that notice names the work back. ``updated_by``: doi, type, source,
    notice; ``update_to``: notice, type, doi."""
    there = updated_by.filter((F.col("type") == "retraction") & (F.col("source") == watch)).select(
        norm_doi(F.col("doi")).alias("_doi"), norm_doi(F.col("notice")).alias("_notice"), "notice"
    )
    back = update_to.filter(F.col("type") == "retraction").select(
        norm_doi(F.col("notice")).alias("_notice"), norm_doi(F.col("doi")).alias("_doi")
    )
    confirmed = (
        there.join(back, ["_notice", "_doi"], "left_semi")
        .groupBy("_doi")
        .agg(F.min("notice").alias("notice"))
    )
    return (
        works.withColumn("_doi", norm_doi(F.col("doi")))
        .join(confirmed, "_doi", "left")
        .withColumn("notice", F.when(F.col("is_retracted"), F.col("notice")))
        .withColumn("is_retracted", F.col("notice").isNotNull())
        .drop("_doi")
    )


def subject_heading_match(forms: DataFrame, records: DataFrame) -> DataFrame:
    """Records filed under any form of a heading; the first form in authority
    order is the match. ``forms``: heading_id, form, ord; ``records``:
    record_id, subjects."""
    filed = records.select("record_id", F.explode(F.array_distinct("subjects")).alias("form"))
    return (
        filed.join(forms, "form")
        .groupBy("heading_id", "record_id")
        .agg(F.min(F.struct("ord", "form")).alias("m"))
        .select("heading_id", "record_id", "m.form")
    )


def subject_names_anchor(subject_tokens: Column, tokens: Column) -> Column:
    """Every token of the name is among the subject's tokens and its joined
    neighbours, or the name run together is."""
    def names(held: Column) -> Column:
        whole = F.size(F.array_except(tokens, held)) == 0
        return whole | F.array_contains(held, F.array_join(tokens, ""))

    return (F.size(tokens) > 0) & let(with_bigrams(subject_tokens), names)


def with_bigrams(tokens: Column) -> Column:
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(tokens, rest, lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(tokens, pairs))


def topic_corroboration(records: DataFrame, topic: DataFrame) -> DataFrame:
    """Records one of whose subjects names another, non-place anchor of the
    page.

    ``records``: page_id, record_id, own, subjects; ``topic``: page_id, qid,
    name, place. Set containment as an equi-join: a name can only be contained
    where its rarest token (or the name run together) occurs, so names are
    joined on those two keys alone and checked in full after. Subjects and
    names are reduced to distinct ones per page first; of each name's anchors
    the least and the greatest id are enough to tell whether another than the
    record's own exists."""
    subjects = (
        records.select("page_id", F.explode(F.array_distinct("subjects")).alias("subject"))
        .distinct()
        .withColumn("st", name_tokens(F.col("subject")))
    )
    names = (
        topic.filter(~F.coalesce("place", F.lit(False)))
        .groupBy("page_id", "name")
        .agg(F.min("qid").alias("lo"), F.max("qid").alias("hi"))
        .withColumn("nt", name_tokens(F.col("name")))
        .filter(F.size("nt") > 0)
    )
    held = subjects.select("page_id", "subject", "st", F.explode(with_bigrams(F.col("st"))).alias("token"))
    frequency = held.groupBy("token").agg(F.count("*").alias("df"))
    rarest = (
        names.select("page_id", "name", F.explode(F.array_distinct("nt")).alias("token"))
        .join(frequency, "token", "left")
        .groupBy("page_id", "name")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r"))
        .select("page_id", "name", F.col("r.token").alias("rare"))
    )
    keyed = names.join(rarest, ["page_id", "name"]).select(
        "page_id", "name", "nt", "lo", "hi",
        F.explode(F.array_distinct(F.array("rare", F.array_join("nt", "")))).alias("token"),
    )
    named = (
        held.join(keyed, ["page_id", "token"])
        .filter(subject_names_anchor(F.col("st"), F.col("nt")))
        .groupBy("page_id", "subject")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    touched = (
        records.select("page_id", "record_id", "own", F.explode(F.array_distinct("subjects")).alias("subject"))
        .join(named, ["page_id", "subject"])
        .filter("own IS NULL OR lo <> own OR hi <> own")
        .select("page_id", "record_id")
        .distinct()
    )
    return records.join(touched, ["page_id", "record_id"], "left_semi")


def corroboration_fields(
    creator: Column, date: Column, institution: Column, person: Column, year: Column, claimed: Column
) -> Column:
    """The fields on which a candidate and a description agree."""
    same_year = F.coalesce(year_of(date) == year_of(year), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(name_matches(creator, person), F.lit("creator")),
            F.when(same_year, F.lit("date")),
            F.when(same_institution(institution, claimed), F.lit("institution")),
        )
    )


def corroborate(cands: DataFrame, described: DataFrame) -> DataFrame:
    """Candidates of a subject against what is said of it; matched only if
    creator, year and institution all agree. ``cands``: subject, creator,
    date, institution; ``described``: subject, person_name, year, claimed."""
    fields = corroboration_fields(
        *[F.col(c) for c in ("creator", "date", "institution", "person_name", "year", "claimed")]
    )
    return (
        cands.join(described, "subject")
        .withColumn("corroborated_by", fields)
        .withColumn("matched", F.size("corroborated_by") == 3)
        .drop("person_name", "year", "claimed")
    )


def thesis_holding(claims: DataFrame, docs: DataFrame, persons: DataFrame, labels: DataFrame) -> DataFrame:
    """The holding of a subject's thesis: the archive id the thesis states, if
    the archive has it, else the first document that agrees in creator, year
    and institution.

    ``claims``: qid, property, ord, value; ``docs``: identifier, ord, title,
    creator, date, institution; ``persons``: qid, name; ``labels``: qid, label.
    Candidates are blocked on (surname, year), both of which must agree."""

    def first_value(prop: str, name: str) -> DataFrame:
        return (
            claims.filter(F.col("property") == prop)
            .groupBy("qid")
            .agg(F.min(F.struct("ord", "value")).alias("v"))
            .select("qid", F.col("v.value").alias(name))
        )

    theses = first_value("P1026", "thesis").withColumnRenamed("qid", "subject")
    said = theses
    for prop, name in (("P724", "stated"), ("P577", "year"), ("P4101", "university")):
        said = said.join(first_value(prop, name).withColumnRenamed("qid", "thesis"), "thesis", "left")
    stated_docs = docs.filter("title IS NOT NULL").select(F.col("identifier").alias("stated")).distinct()
    stated = said.join(stated_docs, "stated").select(
        "subject", "thesis", F.col("stated").alias("identifier"), F.lit("identifier").alias("evidence"),
        F.array().cast("array<string>").alias("corroborated_by"),
    )
    surname = F.element_at(F.split(F.trim(fold(F.col("person_name"))), r"\s+"), -1)
    described = (
        said.join(stated.select("subject"), "subject", "left_anti")
        .join(persons.select(F.col("qid").alias("subject"), F.col("name").alias("person_name")), "subject")
        .join(labels.select(F.col("qid").alias("university"), F.col("label").alias("claimed")), "university")
        .withColumn("_surname", surname)
        .withColumn("_year", year_of(F.col("year")))
    )
    blocked = docs.withColumn("_surname", F.trim(F.split(fold(F.col("creator")), ",")[0])).withColumn(
        "_year", year_of(F.col("date"))
    )
    fields = corroboration_fields(
        *[F.col(c) for c in ("creator", "date", "institution", "person_name", "year", "claimed")]
    )
    # Every wording is judged once: a block pairs distinct descriptions with distinct documents, not all that bear them.
    wording = ["person_name", "year", "claimed"]
    firsts = blocked.groupBy("creator", "date", "institution", "_surname", "_year").agg(F.min(F.struct("ord", "identifier")).alias("f"))
    agreeing = (
        described.select(*wording, "_surname", "_year").distinct()
        .join(firsts, ["_surname", "_year"])
        .withColumn("corroborated_by", fields)
        .filter(F.size("corroborated_by") == 3)
        .groupBy(*wording)
        .agg(F.min(F.struct("f.ord", "f.identifier", "corroborated_by")).alias("d"))
    )
    found = (
        described.join(agreeing, wording)
        .groupBy("subject", "thesis")
        .agg(F.min("d").alias("d"))
        .select(
            "subject", "thesis", "d.identifier", F.lit("corroborated").alias("evidence"), "d.corroborated_by"
        )
    )
    return stated.unionByName(found)


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def inventory_match(statements: DataFrame, records: DataFrame, registry: DataFrame) -> DataFrame:
    """The first record whose normal url ends with the entity's inventory
    number; the stated museum must be registered. A suffix join: see ``prefix_first``."""
    asked = (
        statements.join(registry.select("museum").distinct(), "museum", "left_semi")
        .withColumn("_text", F.reverse(alnum(F.col("inventory"))))
        .filter("_text <> ''")
    )
    held = records.select(F.reverse(alnum(F.col("url"))).alias("text"), F.struct("ord", "record_id").alias("value"))
    found = prefix_first(asked.select(F.col("_text").alias("text")), held)
    return asked.join(found, asked["_text"] == found["text"]).select("qid", "inventory", F.col("value.record_id").alias("record_id"))


def prefix_first(prefixes: DataFrame, texts: DataFrame) -> DataFrame:
    """For every distinct prefix (``text``) the least ``value`` of the ``texts`` (text, value: a struct) that begin with it;
    prefixes that begin none are left out.

    Prefixes and texts are sorted together, so the texts that begin with a prefix follow it without a gap. Each text is one row of
    one sorted range; a range keeps only the prefixes that are open where it reads, each within the one before. A
    prefix that is open where a range begins is one of that range's first text, so these few are found by a join."""
    kind = texts.schema["value"].dataType.simpleString()
    rows = prefixes.select("text", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("value")).distinct().unionByName(
        texts.filter("text <> ''").select("text", F.lit(1).alias("kind"), "value")
    )
    ranged = ordered_ranges(rows, [F.col("text"), F.col("kind")]).sortWithinPartitions("text", "kind")
    first = ranged.groupBy("_range").agg(F.min("text").alias("first"))
    begins = first.select("_range", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substring("first", F.lit(1), n))).alias("text"))
    # At most as many rows as ranges times the longest prefix that is asked for.
    known = ranged.filter("kind = 0").select("text")
    opened: dict[int, list[str]] = {}
    for r in begins.join(known, "text").select("_range", "text").toLocalIterator():
        opened.setdefault(r["_range"], []).append(r["text"])
    parts = ranged.select("_range", "text", "kind", "value").mapInArrow(_open_prefixes(opened), f"text string, value {kind}")
    return parts.groupBy("text").agg(F.min("value").alias("value"))


def _open_prefixes(opened: dict[int, list[str]]):
    def order(value: dict) -> tuple:
        return tuple((x is not None, x) if x is not None else (False,) for x in value.values())

    def better(stack: list[list], value: dict | None) -> None:
        if stack and value is not None and (stack[-1][1] is None or order(value) < order(stack[-1][1])):
            stack[-1][1] = value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        begun, kind = False, None

        def close(out: list[list]) -> None:
            """The innermost open prefix with its least value, which also counts for the one around it."""
            done = stack.pop()
            better(stack, done[1])
            if done[1] is not None:
                out.append(done)

        def told(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], kind)], ["text", "value"])

        for rows in batches:
            out: list[list] = []
            kind = rows.schema.field("value").type
            for number, text, is_text, value in zip(*(rows.column(c).to_pylist() for c in ("_range", "text", "kind", "value")), strict=True):
                if not begun:
                    begun = True
                    stack.extend([p, None] for p in sorted(opened.get(number, []), key=len))
                while stack and not text.startswith(stack[-1][0]):
                    close(out)
                if is_text:
                    better(stack, value)
                elif not stack or stack[-1][0] != text:
                    stack.append([text, None])
            yield told(out)
        out = []
        while stack:
            close(out)
        if begun:
            yield told(out)

    return run


# Scanned parts that belong to the head.
OF_THE_HEAD = ("cranium", "skull", "mandible", "jaw", "teeth", "tooth", "dentition")


def taxon_match(taxa: DataFrame, records: DataFrame, cap: int) -> DataFrame:
    """Scanned specimens of a species: exact folded scientific name and at
    least one model. The whole animal before parts of the head before other
    parts, then source order. ``taxa``: qid, name; ``records``: record_id, ord,
    names, models (count), scan_subject, truncated."""

    def folded(name: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")

    part = F.trim(F.get(F.split("scan_subject", ":"), F.lit(1)))
    rank = (
        F.when(F.col("scan_subject").isNull() | (F.instr("scan_subject", ":") == 0), 0)
        .when(F.arrays_overlap(F.split(F.lower(part), r"\W+"), F.array(*[F.lit(w) for w in OF_THE_HEAD])), 1)
        .otherwise(2)
    )
    scanned = records.filter(F.col("models") > 0)
    named = scanned.withColumn(
        "_name", F.explode(F.array_distinct(F.transform("names", folded)))
    ).withColumn("scan_rank", rank.cast("bigint"))
    asked = taxa.select("qid", folded(F.col("name")).alias("_name")).filter("_name <> ''").distinct()
    # Records are cut to the first few per name before entities multiply them.
    best = top_k(named, ["_name"], ["scan_rank", "ord"], cap, "place")
    totals = named.groupBy("_name").agg(F.count("*").alias("total"), F.bool_or("truncated").alias("truncated"))
    return (
        asked.join(best.drop("truncated"), "_name")
        .join(totals, "_name")
        .select("qid", "record_id", "scan_rank", "place", "total", "truncated")
    )


def derived_visual_id(object_id: Column) -> Column:
    """The image's id as the numbering rule gives it."""
    return F.when(
        object_id.rlike(r"^\d{2}0\d{5,6}$"),
        F.concat(F.substring(object_id, 1, 2), F.lit("2"), F.substr(object_id, F.lit(4))),
    )


def linked_object_chain(objects: DataFrame, visuals: DataFrame, digitals: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Object, then its image, then the file; a missing first link is derived
    from the object's number; later hops may be absent. ``objects``: object_id,
    visual_id; ``visuals``: visual_id, digital_id, rights; ``digitals``:
    digital_id, access_point. Where numbers are unique in a series only,
    ``within`` names the columns of objects and visuals that tell it."""
    linked = objects.withColumn(
        "visual_id", F.coalesce("visual_id", derived_visual_id(F.col("object_id")))
    )
    return linked.join(visuals, ["visual_id", *within], "left").drop(*within).join(digitals, "digital_id", "left")


def select_holder(claims: DataFrame, registry: DataFrame, collection_property: str = "P195", parts: int | None = None) -> DataFrame:
    """The museum that holds an entity: of the registered partners whose id it
    states, one whose collection it also states, else the first in registry
    order. ``registry``: partner, property, collection, ord. ``parts``: how many
    parts rows are dealt to, if not the session's number."""
    best = best_rank_values(claims.filter(F.col("value_id").isNotNull()), parts)
    ids = (
        best.join(registry.withColumnRenamed("ord", "_reg"), "property")
        .groupBy("qid", "partner", "property", "collection", "_reg")
        .agg(F.min(F.struct("ord", "value_id")).alias("v"))
    )
    collections = best.filter(F.col("property") == collection_property).select("qid", F.col("value_id").alias("collection"))
    stated = deal(collections, parts, "qid", "collection").distinct().withColumn("_there", F.lit(True))
    order = F.struct(F.col("_there").isNull().alias("away"), "_reg")
    return (
        deal(ids.join(stated, ["qid", "collection"], "left"), parts, "qid")
        .groupBy("qid")
        .agg(F.min_by(F.struct("partner", "property", F.col("v.value_id").alias("id")), order).alias("h"))
        .select("qid", "h.*")
    )


def partner_host_match(hosts: DataFrame, partners: DataFrame) -> DataFrame:
    """Hosts that are a partner's base or lie under it."""
    return (
        hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("base"))
        .join(partners, "base")
        .select("host", "slug", "base")
    )


def scan_title(title: Column) -> Column:
    """Title up to the first ; : or /, one-spaced, without a closing year."""
    head = F.split(title, "[;:/]")[0]
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"\s+", " "), r"[,\s]*+\b\d{4}$", ""))


def verify_scans(works: DataFrame, scans: DataFrame) -> DataFrame:
    """Whether a scan belongs to its work: yes when it names the work's key or
    one folded title contains the other, no otherwise, unknown without a
    record. ``alien``: a scan that belongs but whose own caption says something
    else. ``works``: work_key, title, scan_id; ``scans``: scan_id, scan_title,
    scan_work."""
    joined = works.join(scans.withColumn("_seen", F.lit(True)), "scan_id", "left")
    work, scan, caption = (norm_title(F.col(c)) for c in ("title", "scan_title", "_caption"))

    def contain(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))

    same_key = F.coalesce(F.col("scan_work") == F.col("work_key"), F.lit(False))
    owned = F.when(F.col("_seen"), same_key | contain(scan, work))
    alien = (
        F.coalesce("owned", F.lit(False))
        & (caption != "") & (work != "") & ~F.contains(caption, work) & ~F.contains(work, caption)
    )
    return (
        joined.withColumn("_caption", scan_title(F.col("scan_title")))
        .withColumn("owned", owned)
        .withColumn("alien", alien)
        .drop("_seen", "_caption")
    )


# Infobox label -> holder field; a type is a medium only where
# no medium is stated; a location is never compared.
FIELD_LABELS = {
    "artist": "creator",
    "year": "date",
    "medium": "medium",
    "dimensions": "dimensions",
    "type": "medium",
    "accession": "accession",
    "credit line": "credit",
}
HOLDER_FIELDS = ("creator", "date", "medium", "dimensions", "accession", "credit")


def panel_compare(rows: DataFrame, holdings: DataFrame) -> DataFrame:
    """Article facts against the holder's record: agree, conflict,
    article-only, holder-only. A field is compared with its first row only.
    ``rows``: page_id, ord, label, value; ``holdings``: page_id and the fields."""

    def normal(text: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))

    with_medium = (
        rows.filter(normal(F.col("label")) == "medium").select("page_id").distinct().withColumn("_medium", F.lit(True))
    )
    mapping = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    label = normal(F.col("label"))
    field = F.when(
        ~((label == "type") & F.coalesce("_medium", F.lit(False))), F.try_element_at(mapping, label)
    )
    mapped = rows.join(with_medium, "page_id", "left").withColumn("field", field).drop("_medium")
    mapped = mapped.join(holdings.select("page_id").distinct(), "page_id", "left_semi")
    # the row each field is compared with: one per page and field
    used = mapped.filter("field IS NOT NULL").groupBy("page_id", "field").agg(
        F.min(F.struct("ord", "label", "value")).alias("r")
    ).select("page_id", "field", "r.*")
    other = mapped.join(
        used.select("page_id", "ord"), ["page_id", "ord"], "left_anti"
    ).select(
        "page_id", F.lit(None).cast("string").alias("field"), "ord", "label",
        F.col("value").alias("article"), F.lit(None).cast("string").alias("holder"),
    )
    facts = holdings.select(
        "page_id",
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("field"), blank_to_null(F.col(f).cast("string")).alias("holder")) for f in HOLDER_FIELDS
        ])),
    )
    both = used.withColumnRenamed("value", "article").join(facts, ["page_id", "field"], "full_outer")
    status = (
        F.when(F.col("ord").isNull(), "holder-only")
        .when(F.col("holder").isNull(), "article-only")
        .when(normal(F.col("article")) == normal(F.col("holder")), "agree")
        .otherwise("conflict")
    )
    return (
        both.unionByName(other)
        .filter("ord IS NOT NULL OR holder IS NOT NULL")
        .withColumn("status", status)
    )


def pick_picture(items: DataFrame, lead: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picture of each item: its article's lead image, else its archive file,
    else the thumbnail it states; and how many items each route serves.
    ``items``: item_id, title, file_title, thumbnail, source; ``lead``: title,
    source_url, width, height, lead_file; ``files``: file_title, thumb_url,
    width, height, credit."""

    def picture(url: Column, aspect: Column, credit: Column, route: str) -> Column:
        return F.struct(
            url.alias("url"), aspect.alias("aspect"), credit.alias("credit"), F.lit(route).alias("route")
        )

    leads = lead.select(
        "title", "source_url", F.try_divide("height", "width").alias("_aspect"), F.col("lead_file").alias("_lead_file")
    )
    own = files.select(
        "file_title", "thumb_url", F.try_divide("height", "width").alias("_file_aspect"), F.col("credit").alias("_file_credit")
    )
    credits = files.select(F.col("file_title").alias("_lead_file"), F.col("credit").alias("_lead_credit"))
    joined = (
        items.join(leads, "title", "left").join(credits, "_lead_file", "left").join(own, "file_title", "left")
    )
    none = F.lit(None).cast("double")
    map_credit = F.when(F.col("source") == "openstreetmap", F.lit("© OpenStreetMap contributors"))
    chosen = F.coalesce(
        F.when(F.col("source_url").isNotNull(), picture(F.col("source_url"), F.col("_aspect"), F.col("_lead_credit"), "lead")),
        F.when(F.col("thumb_url").isNotNull(), picture(F.col("thumb_url"), F.col("_file_aspect"), F.col("_file_credit"), "file")),
        F.when(F.col("thumbnail").isNotNull(), picture(F.col("thumbnail"), none, map_credit, "stated")),
    )
    out = joined.withColumn("picture", chosen).select("item_id", "picture.*")
    counts = out.groupBy(F.coalesce("route", F.lit("none")).alias("route")).agg(F.count("*").alias("items"))
    return out, counts


def scan_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(?:services/img|details)/([^/?#]+)", 1)
    return F.when(found != "", found)


def dedupe_against_rail(hits: DataFrame, rail: DataFrame) -> DataFrame:
    """Archive hits whose book is not on the rail already, by ISBN or by link,
    and of each scan only the first. ``hits``: page_id, section_ord, ord, isbn,
    image_url; ``rail``: page_id, section_ord, isbn, href."""
    section = ["page_id", "section_ord"]
    marked = hits.withColumn("scan_id", scan_of(F.col("image_url")))
    linked = rail.select(*section, scan_of(F.col("href")).alias("scan_id")).filter("scan_id IS NOT NULL").distinct()
    cited = rail.select(*section, "isbn").filter("isbn IS NOT NULL").distinct()
    left = marked.join(cited, [*section, "isbn"], "left_anti").join(linked, [*section, "scan_id"], "left_anti")
    once = top_k(left.filter("scan_id IS NOT NULL"), [*section, "scan_id"], ["ord"])
    return once.unionByName(left.filter("scan_id IS NULL").select(*once.columns))


def subject_works(
    claims: DataFrame,
    labels: DataFrame,
    sitelinks: DataFrame,
    museums: dict[str, str],
    creator_property: str = "P170",
) -> DataFrame:
    """Works by a subject that some museum's id is stated for: one wide row
    per subject and work. Works without a label of their own are dropped.
    ``museums``: variable -> property."""
    made = claims.filter(F.col("property") == creator_property).select(
        F.col("value_id").alias("subject"), F.col("qid").alias("work")
    ).distinct()
    ids = (
        claims.filter(F.col("property").isin(*museums.values()))
        .groupBy(F.col("qid").alias("work"))
        .agg(*[F.min(F.when(F.col("property") == p, F.col("value_id"))).alias(v) for v, p in museums.items()])
    )
    named = labels.filter(F.col("label") != F.col("qid").cast("string")).groupBy(F.col("qid").alias("work")).agg(
        F.min("label").alias("label")
    )
    linked = sitelinks.select(F.col("qid").alias("work")).distinct().withColumn("_linked", F.lit(True))
    return (
        made.join(ids, "work")
        .join(named, "work")
        .join(linked, "work", "left")
        .withColumn("sitelink", F.coalesce("_linked", F.lit(False)))
        .drop("_linked")
    )


def holder_census(
    claims: DataFrame,
    sitelinks: DataFrame,
    classes: DataFrame,
    registry: DataFrame,
    class_property: str = "P31",
    collection_property: str = "P195",
    parts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Works with an article and a museum's id: one row per distinct stated
    id with the item's number of collections; and items per selected holder.
    ``parts``: how many parts rows are dealt to, if not the session's number."""
    best = best_rank_values(claims.filter(F.col("value_id").isNotNull()), parts)
    kinds = best.filter(F.col("property") == class_property).join(
        deal(classes.select(F.col("class").alias("value_id")), parts, "value_id").distinct(), "value_id", "left_semi"
    ).select("qid")
    articles = deal(sitelinks, parts, "qid").groupBy("qid").agg(F.min("title").alias("title"))
    items = articles.join(kinds, "qid", "left_semi")
    pairs = (
        best.join(registry.select("property"), "property", "left_semi")
        .select("qid", "property", F.col("value_id").alias("id"))
        .distinct()
    )
    collections = deal(best.filter(F.col("property") == collection_property), parts, "qid").groupBy("qid").agg(
        F.countDistinct("value_id").alias("collections")
    )
    rows = (
        pairs.join(items, "qid")
        .join(collections, "qid", "left")
        .withColumn("collections", F.coalesce("collections", F.lit(0)))
    )
    picked = select_holder(
        claims.join(rows.select("qid").distinct(), "qid", "left_semi"), registry, collection_property, parts
    )
    return rows, picked.groupBy("partner").agg(F.count("*").alias("items"))


def subclass_control(
    claims: DataFrame,
    edges: DataFrame,
    classes: DataFrame,
    registry: DataFrame,
    sitelinks: DataFrame,
    class_property: str = "P31",
) -> DataFrame:
    """How many items with an article and a museum's id are works only through
    a subclass. ``edges``: child, parent; what lies below a class is found from above, without the closure."""
    best = best_rank_values(claims.filter(F.col("value_id").isNotNull()))
    of_class = best.filter(F.col("property") == class_property).select("qid", F.col("value_id").alias("class"))
    known = classes.select("class").distinct()
    direct = of_class.join(known, "class", "left_semi").select("qid")
    below = descendants(edges, known.withColumn("mark", F.lit("work"))).select("class")
    held = best.join(registry.select("property"), "property", "left_semi").select("qid")
    return (
        of_class.join(below, "class", "left_semi")
        .join(direct, "qid", "left_anti")
        .join(sitelinks.select("qid"), "qid", "left_semi")
        .join(held, "qid", "left_semi")
        .agg(F.countDistinct("qid").alias("n"))
    )


def footnotes(markers: DataFrame, notes: DataFrame, access: DataFrame) -> DataFrame:
    """Notes in marker order, each name once per section; the ISBN its body
    links, if it has ten or thirteen digits, and what access that book has.
    ``markers``: page_id, section_ord, ord, name, num; ``notes``: page_id, name,
    body; ``access``: page_id, section_ord, isbn, access."""
    first = markers.groupBy("page_id", "section_ord", "name").agg(F.min(F.struct("ord", "num")).alias("m")).select(
        "page_id", "section_ord", "name", "m.ord", "m.num"
    )
    digits = F.regexp_replace(
        F.regexp_extract("body", r"Special:BookSources/([0-9Xx-]+)", 1), "[^0-9Xx]", ""
    )
    known = access.filter("isbn IS NOT NULL AND access IS NOT NULL").groupBy(
        "page_id", "section_ord", "isbn"
    ).agg(F.min("access").alias("access"))
    return (
        first.join(notes, ["page_id", "name"])
        .withColumn("isbn", F.when(F.length(digits).isin(10, 13), digits))
        .join(known, ["page_id", "section_ord", "isbn"], "left")
    )
