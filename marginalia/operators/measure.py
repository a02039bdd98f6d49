"""Coverage, tallies, censuses and other aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.identifiers import host_of, host_suffixes
from marginalia.functions.ordering import running_sum, top_k
from marginalia.session import deal

COVERAGE = ("total", "open", "cataloged", "linked", "unchecked")


def n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def citation_coverage(cites: DataFrame, searched: Column | bool = True) -> DataFrame:
    """Per section: how many cited works are open, catalogued, linked or could
    not be checked. ``cites`` carries access, unchecked and has_link."""
    access, unchecked = F.col("access"), F.coalesce("unchecked", F.lit(False))
    return cites.groupBy("page_id", "section_ord").agg(
        F.count("*").alias("total"),
        n(access.isin("full", "borrow")).alias("open"),
        n(access == "catalog").alias("cataloged"),
        n(access.isNull() & ~unchecked & F.col("has_link")).alias("linked"),
        n(unchecked).alias("unchecked"),
        F.bool_or(F.lit(searched) if isinstance(searched, bool) else searched).alias("searched"),
    )


def page_coverage(
    coverage: DataFrame, papers: DataFrame | None, levels: Sequence[str]
) -> DataFrame:
    """Section coverage and paper counts rolled up over ``levels`` (for
    example site, page, section); a level counts as searched if any section
    below it was. ``depth`` is the number of levels still named in the row."""
    sums = [*COVERAGE]
    if papers is not None:
        coverage = coverage.join(papers, ["page_id", "section_ord"], "left")
        sums += ["papers_total", "papers_open"]
    rolled = coverage.rollup(*levels).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in sums],
        F.bool_or("searched").alias("searched"),
        F.grouping_id().alias("_gid"),
    )
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("_gid"), F.lit("0")))
    return rolled.withColumn("depth", depth.cast("bigint")).drop("_gid")


def hosts_under(hosts: DataFrame, bases: DataFrame) -> DataFrame:
    """Distinct (host, slug): the partner base a host is or lies under."""
    return (
        hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("base"))
        .join(bases, "base")
        .select("host", "slug")
        .distinct()
    )


def partner_tally(
    entries: DataFrame,
    footnotes: DataFrame,
    partners: DataFrame,
    left_out: Sequence[str] = ("openalex",),
    parts: int | None = None,
) -> DataFrame:
    """Cards and notes per page and partner. A note counts for the partner
    whose base host its access link lies under; paper catalogues are left out
    there, since a link to their resolver names somebody else's copy. ``parts``:
    how many parts rows are dealt to by page, if not the session's number."""
    cards = entries.filter(F.col("source").isNotNull()).select(
        "page_id", F.col("source").alias("slug"), F.lit(1).alias("cards"), F.lit(0).alias("notes")
    )
    hosts = footnotes.select("page_id", host_of(F.col("access_url")).alias("host")).filter(
        "host IS NOT NULL"
    )
    # Notes are counted per page and host, and every host is resolved once. Few hosts bear most notes: dealt by host, no more
    # tasks than hosts would have rows. So the hosts of partners go to the counts.
    counted = deal(hosts, parts, "page_id", "host").groupBy("page_id", "host").agg(F.count("*").alias("notes"))
    bases = partners.filter(~F.col("slug").isin(*left_out)).select("slug", "base").distinct()
    resolved = F.broadcast(hosts_under(hosts.select("host").distinct(), bases))
    notes = counted.join(resolved, "host").select("page_id", "slug", F.lit(0).alias("cards"), "notes")
    return (
        deal(cards.unionByName(notes), parts, "page_id", "slug")
        .groupBy("page_id", "slug")
        .agg(F.sum("cards").alias("cards"), F.sum("notes").alias("notes"))
    )


def visibility_report(
    tally: DataFrame,
    reach: DataFrame,
    hosts: DataFrame,
    map_partner: str,
    bar_partners: Sequence[str],
    doi_partner: str,
) -> DataFrame:
    """Whether the article shows, links or omits each partner that contributed.

    ``reach``: page_id, host (one row per linked host), kartographer,
    identifier_bar; ``hosts``: slug, base and, for hosts only some page's cards
    point at, page_id. ``place`` ranks the rows of a page by tier, then weight."""
    flags = reach.groupBy("page_id").agg(
        F.bool_or("kartographer").alias("kartographer"),
        F.bool_or("identifier_bar").alias("identifier_bar"),
    )
    linked_hosts = reach.filter("host IS NOT NULL").select("page_id", "host").distinct()
    general = linked_hosts.join(
        hosts_under(linked_hosts.select("host").distinct(), hosts.filter("page_id IS NULL").select("slug", "base")), "host"
    )
    carded = linked_hosts.select(
        "page_id", F.explode(host_suffixes(F.col("host"))).alias("base")
    ).distinct().join(hosts.filter("page_id IS NOT NULL"), ["page_id", "base"])
    linked = (
        general.select("page_id", "slug")
        .unionByName(carded.select("page_id", "slug"))
        .distinct()
        .withColumn("linked", F.lit(True))
    )
    mapped = (F.col("slug") == map_partner) & F.coalesce("kartographer", F.lit(False))
    tier = F.when(mapped, "shown").when(F.col("linked"), "link").otherwise("invisible")
    where = (
        F.when(F.col("tier") == "shown", "map")
        .when(F.col("tier") == "invisible", F.lit(None))
        .when(F.col("slug") == doi_partner, "doi")
        .when(F.col("identifier_bar") & F.col("slug").isin(*bar_partners), "identifier-bar")
        .otherwise("small-print")
    )
    rows = (
        tally.join(linked, ["page_id", "slug"], "left")
        .join(flags, "page_id", "left")
        .withColumn("tier", tier)
        .withColumn("place_of_link", where)
    )
    # One row per page and partner: bounded by the partner registry.
    order = Window.partitionBy("page_id").orderBy(
        F.when(F.col("tier") == "shown", 0).when(F.col("tier") == "link", 1).otherwise(2),
        F.desc(F.col("cards") + F.col("notes")),
        "slug",
    )
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).select(
        "page_id", "slug", "cards", "notes", "tier", "place_of_link", "place"
    )


def gap_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("page_id").agg(
        F.count("*").alias("total"),
        *[n(F.col("tier") == t).alias(t) for t in ("shown", "link", "invisible")],
    )


def artwork_totals(works: DataFrame, museums: Sequence[str]) -> DataFrame:
    """Per subject: works each museum holds, and works overall."""
    return works.groupBy("subject").agg(
        *[F.count(m).alias(m) for m in museums], F.count("*").alias("works")
    )


def sources_and_evidence(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Per page, the sources used in registry order and the fields that
    corroboration rested on. ``registry``: source, ord."""
    used = (
        entries.select("page_id", "source").distinct().join(registry, "source")
    )
    sources = used.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("s")
    )
    fields = (
        entries.filter(F.col("evidence") == "corroborated")
        .select("page_id", F.explode("corroborated_by").alias("field"))
        .distinct()
        .groupBy("page_id")
        .agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields"))
    )
    return sources.join(fields, "page_id", "left").select(
        "page_id",
        F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"),
        F.coalesce("fields", F.lit("")).alias("fields"),
    )


def sample_disclosure(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """What is shown of what was found, per page, source and topic; a total
    that the search itself cut short is marked as a lower bound."""
    keys = ["page_id", "source", "topic"]
    shown = entries.groupBy(*keys).agg(F.count("*").alias("shown"))
    return shown.join(totals, keys).select(
        *keys,
        "shown",
        "total",
        (F.col("shown") < F.col("total")).alias("is_sample"),
        F.coalesce("truncated", F.lit(False)).alias("at_least"),
    )


def shelf_groups(entries: DataFrame, prose: DataFrame, long_prose: int = 700) -> DataFrame:
    """Shelves of a section: one row per source and topic, in first-seen order
    of the source and then of the topic. A shelf of one illustrated item in a
    section with much prose goes to the gutter, except in the lede."""
    keys = ["page_id", "section_ord", "source"]
    shelves = entries.groupBy(*keys, "topic").agg(
        F.min("ord").alias("first_ord"), F.count("*").alias("items"), F.bool_or("has_image").alias("_image"),
    )
    by_source = shelves.groupBy(*keys).agg(
        F.min("first_ord").alias("source_first"), F.count("*").alias("topics")
    )
    single = (F.col("items") == 1) & F.col("_image")
    long_enough = (F.col("prose_chars") >= long_prose) & (F.col("section_ord") > 1)
    return (
        shelves.join(by_source, keys)
        .join(prose, ["page_id", "section_ord"], "left")
        .select(
            *keys, "topic", "first_ord", "source_first", "items", "topics",
            F.coalesce(single & long_enough, F.lit(False)).alias("gutter"),
        )
    )


def link_strength(edges: DataFrame) -> DataFrame:
    """Distinct authority systems behind each unordered pair, and its class."""
    return (
        edges.select(
            F.least("src", "dst").alias("a"),
            F.greatest("src", "dst").alias("b"),
            F.explode_outer("linked_via").alias("system"),
        )
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("system").alias("systems"))
        .withColumn(
            "strength",
            F.when(F.col("systems") >= 4, "strong").when(F.col("systems") >= 2, "medium").otherwise("weak"),
        )
    )


def request_load(log: DataFrame) -> DataFrame:
    """Requests per host and the most that ran at once. A request runs from
    its start up to, not including, its end. Starts and ends at one instant
    are netted first, then summed over time, in ranges for a busy host."""
    counts = log.groupBy("host").agg(F.count("*").alias("requests"))
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = start + F.round(F.col("duration_s") * 1_000_000).cast("bigint")
    steps = log.select(
        "host",
        F.inline(F.array(
            F.struct(start.alias("at"), F.lit(1).alias("step")),
            F.struct(end.alias("at"), F.lit(-1).alias("step")),
        )),
    )
    net = steps.groupBy("host", "at").agg(F.sum("step").alias("step"))
    running = running_sum(net, ["host"], ["at"], "step", "active")
    peaks = running.groupBy("host").agg(F.max("active").cast("bigint").alias("peak"))
    return counts.join(peaks, "host")


def warm_outcomes(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcome of each render, counts per kind and reason, and how often each
    refusing host left a page thin. ``log``: title, status, complete, thin
    (array of hosts), timed_out."""
    ok = (F.col("status") >= 200) & (F.col("status") < 300) & F.col("complete") & ~F.col("timed_out")
    kind = F.when(ok & (F.size("thin") > 0), "thin").when(ok, "ok").otherwise("failed")
    reason = (
        F.when(F.col("kind") != "failed", F.lit(None))
        .when(F.col("timed_out"), "no answer")
        .when(F.col("status") == 503, "busy")
        .when(~F.col("complete"), "stream cut short")
        .otherwise(F.concat(F.lit("status "), F.col("status").cast("string")))
    )
    rows = log.withColumn("kind", kind).withColumn("reason", reason)
    counts = rows.groupBy("kind", "reason").agg(F.count("*").alias("renders"))
    hosts = (
        rows.filter("kind = 'thin'")
        .select("title", F.explode(F.array_distinct("thin")).alias("host"))
        .groupBy("host")
        .agg(F.count("*").alias("thin_pages"))
    )
    return rows, counts, hosts


def open_tier_crosstab(works: DataFrame, licences: Sequence[str]) -> DataFrame:
    """Works per tier and stated licence, with the share that states none.
    Licences outside the list fall under ``other``."""
    named = F.when(F.col("licence").isin(*licences), F.col("licence")).when(
        F.col("licence").isNotNull(), "other"
    ).otherwise("none")
    table = (
        works.select("tier", named.alias("licence"))
        .groupBy("tier")
        .pivot("licence", [*licences, "other", "none"])
        .count()
        .na.fill(0)
    )
    total = sum((F.col(c) for c in [*licences, "other", "none"]), F.lit(0))
    return table.withColumn("works", total).withColumn(
        "share_none", F.col("none") / F.col("works")
    )


def missing_image_census(entries: DataFrame, keep: int) -> DataFrame:
    """Entries without an image by landing host, the long tail folded into
    one row; shares are of all entries without one."""
    by_host = entries.groupBy("host").agg(
        F.count("*").alias("entries"), n(F.col("image_url").isNull()).alias("missing")
    )
    head = by_host.orderBy(F.desc("missing"), "host").limit(keep).select(
        "host", F.lit(True).alias("_head")
    )
    folded = (
        by_host.join(F.broadcast(head), "host", "left")
        .groupBy(F.when(F.col("_head"), F.col("host")).otherwise("other").alias("host"))
        .agg(F.sum("entries").alias("entries"), F.sum("missing").alias("missing"))
    )
    everything = by_host.agg(F.sum("missing").alias("_all"))
    return folded.crossJoin(F.broadcast(everything)).select(
        "host",
        F.col("entries").cast("bigint").alias("entries"),
        F.col("missing").cast("bigint").alias("missing"),
        F.try_divide("missing", "_all").alias("share"),
    )


def entity_statement_stats(claims: DataFrame) -> DataFrame:
    """Statements by property and rank with all subtotals; shares of
    deprecated and of unreferenced statements."""
    deprecated = n(F.col("rank") == "deprecated")
    bare = n(F.col("reference_count") == 0)
    return claims.cube("property", "rank").agg(
        F.count("*").alias("statements"),
        deprecated.alias("deprecated"),
        bare.alias("unreferenced"),
        (deprecated / F.count("*")).alias("deprecated_share"),
        (bare / F.count("*")).alias("unreferenced_share"),
        F.grouping_id().cast("bigint").alias("grouping"),
    )


def assemble_bands(routes: Sequence[DataFrame]) -> DataFrame:
    """Entries of all routes in route order. ``entry_ord`` sorts a section's
    entries: first by route, then by the route's own order."""
    tagged = [
        route.withColumn("route", F.lit(i).cast("bigint")) for i, route in enumerate(routes)
    ]
    out = tagged[0]
    for route in tagged[1:]:
        out = out.unionByName(route, allowMissingColumns=True)
    return out


def unique_entries(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First entry per title and description."""
    return top_k(entries, [*by, "title", "description"], ["ord"], 1)


def merge_prefer_first(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both results per key; where both answer, the first pass stands."""
    return first.unionByName(second.join(first.select(*key), list(key), "left_anti"))


def exclude_shown(cands: DataFrame, shown: DataFrame, key: Sequence[str]) -> DataFrame:
    return cands.join(shown.select(*key), list(key), "left_anti")
