"""Orders, budgets, picks and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.ordering import rank_within, running_sum, top_k
from marginalia.functions.text import fold_key, folded_title, score_tokens
from marginalia.session import deal

SECTION = ("page_id", "section_ord")

# Properties that name a particular thing, person or place.
NAMES_A_THING = (
    "P170", "P50", "P84", "P86", "P57", "P58", "P175", "P110", "P98", "P112", "P488",
    "P195", "P276", "P131", "P159", "P19", "P20", "P189",
    "P180", "P921", "P941", "P138", "P144",
    "P710", "P108", "P69", "P184", "P185", "P1344",
    "P800", "P1026", "P1441", "P171", "P793",
)

# Statement variables that identify one object, and the others
# under which something can be found.
ITEM_HOOKS = ("met", "aic", "rijks", "cleveland", "getty", "iiif", "inat", "gbif", "si")
OTHER_HOOKS = ("lc", "eu", "coord", "osmr", "osmw", "osmn")


def best_rank_values(claims: DataFrame, parts: int | None = None) -> DataFrame:
    """Preferred statements where there are any, else the normal ones. The
    flag travels as one row per (qid, property), so a property stated a
    million times is never gathered in one task. ``parts``: how many parts
    rows are dealt to, if not the session's number."""
    live = deal(claims.filter(F.col("rank").isin("preferred", "normal")), parts, "qid", "property")
    preferred = (
        live.filter("rank = 'preferred'")
        .select("qid", "property")
        .distinct()
        .withColumn("_has_preferred", F.lit(True))
    )
    return (
        live.join(preferred, ["qid", "property"], "left")
        .filter((F.col("rank") == "preferred") | F.col("_has_preferred").isNull())
        .drop("_has_preferred")
    )


def work_class(claims: DataFrame, classes: DataFrame, class_property: str = "P31") -> DataFrame:
    """Medium of the first best-rank class that is a class of works.
    ``classes``: class, medium (a registry)."""
    values = best_rank_values(claims.filter(F.col("property") == class_property))
    hits = values.join(classes, values["value_id"] == classes["class"])
    return hits.groupBy("qid").agg(F.min_by("medium", F.struct("ord", "medium")).alias("medium"))


def subject_anchors(claims: DataFrame, naming: Sequence[str] = NAMES_A_THING) -> DataFrame:
    """Entities a subject's claims point at; rank 0 if some property names a
    thing, else 1."""
    rank = F.when(F.col("property").isin(*naming), 0).otherwise(1)
    return claims.groupBy("qid", "value_id").agg(F.min(rank).cast("bigint").alias("rank"))


def hook_tier(
    statements: DataFrame,
    anchors: DataFrame,
    item_hooks: Sequence[str] = ITEM_HOOKS,
    other_hooks: Sequence[str] = OTHER_HOOKS,
) -> tuple[DataFrame, DataFrame]:
    """Tier of every anchor (0 one object, 1 some hook, 2 nothing stated) and
    the share of each page's anchors per tier."""
    item = F.coalesce(*[F.col(h).cast("string") for h in item_hooks if h in statements.columns], F.lit(None))
    other = F.coalesce(*[F.col(h).cast("string") for h in other_hooks if h in statements.columns], F.lit(None))
    tier = F.when(item.isNotNull(), 0).when(other.isNotNull(), 1).otherwise(2)
    tiers = statements.select("qid", tier.cast("bigint").alias("_tier"))
    tiered = anchors.join(tiers, "qid", "left").withColumn(
        "tier", F.coalesce("_tier", F.lit(2)).cast("bigint")
    ).drop("_tier")
    counts = tiered.groupBy("page_id", "tier").agg(F.count("*").alias("anchors"))
    totals = counts.groupBy("page_id").agg(F.sum("anchors").alias("_all"))
    profile = counts.join(totals, "page_id").select(
        "page_id", "tier", "anchors", (F.col("anchors") / F.col("_all")).alias("share")
    )
    return tiered, profile


def order_candidates(cands: DataFrame, related: DataFrame, tiers: DataFrame) -> DataFrame:
    """Candidates of a section in order of use: on the lede those the
    subject's claims name come first; then by hook tier; then article order.
    All are kept. ``related``: page_id, cand, related; ``tiers``: cand, tier."""
    joined = cands.join(related, ["page_id", "cand"], "left").join(tiers, "cand", "left")
    on_lede = F.when(F.col("section_ord") == 1, F.coalesce("related", F.lit(2))).otherwise(0)
    ranked = rank_within(
        joined.withColumn("_related", on_lede).withColumn("tier", F.coalesce("tier", F.lit(2))),
        [*SECTION], ["_related", "tier", "ord"], "place",
    )
    return ranked.select("page_id", "section_ord", "ord", "cand", "place")


def prefer_open(papers: DataFrame) -> DataFrame:
    """Papers that can be shown, licensed copies first, article order kept.
    Retracted ones are marked and carry no place: they stand outside the cap."""
    shown = papers.filter(F.col("found") & ~F.col("retracted")).withColumn(
        "open_rank", F.when(F.col("licensed"), 0).otherwise(1).cast("bigint")
    )
    ranked = rank_within(shown, [*SECTION], ["open_rank", "ord"], "place")
    retracted = papers.filter(F.col("found") & F.col("retracted"))
    return ranked.unionByName(retracted, allowMissingColumns=True)


def rank_citations(cites: DataFrame, kind_rank: Column, cap: int) -> DataFrame:
    """At most ``cap`` citations per section by kind, then article order."""
    return top_k(cites.withColumn("kind_rank", kind_rank), [*SECTION], ["kind_rank", "ord"], cap, "place")


def book_archive_rest() -> Column:
    """Books first, then archived sources, then the rest."""
    return F.when(F.col("isbn").isNotNull(), 0).when(F.col("archive_url").isNotNull(), 1).otherwise(2)


def card_budgets(cards: DataFrame, most: int, maps: int) -> DataFrame:
    """At most ``most`` cards per section, of them ``maps`` maps, spent in
    anchor order. A map beyond its budget takes no card, so the maps are cut
    first and the cards after."""
    order = ["anchor_ord", "ord"]
    is_map = F.coalesce("is_map", F.lit(False))
    first_maps = top_k(cards.filter(is_map), [*SECTION], order, maps)
    return top_k(cards.filter(~is_map).unionByName(first_maps), [*SECTION], order, most, "place")


def pick_hero(
    entries: DataFrame, prose: DataFrame, long_prose: int = 700
) -> tuple[DataFrame, DataFrame]:
    """The lead entry of each section and the rest. Rank by standing, then by
    what can be seen; the first of equals; none if it shows nothing; none in a
    section of little prose unless it is the held work itself."""
    standing, visual = F.col("standing"), F.coalesce("visual", F.lit(False))
    rank = (
        F.when(standing == "holder-work", -1)
        .when(standing == "subject-document", 0)
        .when((standing == "subject-record") & visual, 1)
        .when(standing == "subject-record", 2)
        .when(standing == "subject-work", 3)
        .when(F.col("source") == "openstreetmap", 5)
        .when(visual, 4)
        .otherwise(6)
    )
    best = top_k(entries.withColumn("hero_rank", rank.cast("bigint")), [*SECTION], ["hero_rank", "ord"])
    worth = visual | F.coalesce(standing == "subject-document", F.lit(False))
    long_enough = (F.coalesce("prose_chars", F.lit(0)) >= long_prose) | F.coalesce(
        standing == "holder-work", F.lit(False)
    )
    hero = best.filter(worth).join(prose, [*SECTION], "left").filter(long_enough)
    rest = entries.join(hero.select(*SECTION, "ord"), [*SECTION, "ord"], "left_anti")
    return hero, rest


def rank_shelf(entries: DataFrame, by: Sequence[str], cap: int) -> DataFrame:
    """Best ``cap`` entries of a shelf: two points per distinct title token
    shared with heading or anchor, one for a picture; one entry per folded
    title."""
    want = F.array_union(score_tokens(F.col("anchor_label")), score_tokens(F.col("heading")))
    hits = F.size(F.array_intersect(score_tokens(F.col("title")), want))
    scored = entries.withColumn(
        "score", (hits * 2 + F.when(F.col("image_url").isNotNull(), 1).otherwise(0)).cast("bigint")
    ).withColumn("_key", fold_key(F.col("title")))
    distinct = top_k(scored, [*by, "_key"], [F.desc("score"), "ord"])
    return top_k(distinct, by, [F.desc("score"), "ord"], cap, "place").drop("_key")


def pick_diverse(works: DataFrame, cap: int, exclude: DataFrame | None = None) -> DataFrame:
    """Round robin over museums: each takes its next work nobody took yet,
    those with an article first, then by id, until ``cap`` works are picked.

    ``works``: subject, work, sitelink, museum, museum_ord. A museum never
    needs more than its first ``cap`` works, since no more are taken in all;
    what is gathered per subject is therefore at most museums x cap rows."""
    if exclude is not None:
        works = works.join(exclude, ["subject", "work"], "left_anti")
    queues = top_k(
        works, ["subject", "museum"], [F.desc("sitelink"), "work"], cap, "_pos"
    )
    grouped = queues.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.struct("museum_ord", "_pos", "work", "museum"))).alias("q")
    )
    museums = F.array_sort(F.array_distinct(F.transform("q", lambda x: x["museum_ord"])))
    turns = F.flatten(F.array_repeat(museums, cap))
    work_type = works.schema["work"].dataType.simpleString()
    museum_type = works.schema["museum"].dataType.simpleString()
    start = F.array().cast(f"array<struct<work:{work_type},museum:{museum_type}>>")

    def take(picked: Column, turn: Column) -> Column:
        free = F.filter(
            F.col("q"),
            lambda x: (x["museum_ord"] == turn) & ~F.exists(picked, lambda p: p["work"] == x["work"]),
        )
        first = F.get(free, F.lit(0))
        more = F.array_append(picked, F.struct(first["work"].alias("work"), first["museum"].alias("museum")))
        return F.when((F.size(picked) < cap) & (F.size(free) > 0), more).otherwise(picked)

    return (
        grouped.select("subject", F.posexplode(F.aggregate(turns, start, take)))
        .select("subject", (F.col("pos") + 1).cast("bigint").alias("place"), "col.work", "col.museum")
    )


def dedupe_shards(works: DataFrame, cap: int) -> DataFrame:
    """One record per author and folded title, the one with most editions, the
    first of equals; illustrated ones first, then the first ``cap``."""
    keyed = works.withColumn("_key", folded_title(F.col("title")))
    best = top_k(keyed, ["author", "_key"], [F.desc(F.coalesce("editions", F.lit(0))), "ord"])
    return top_k(best, ["author"], [F.desc("has_image"), "ord"], cap, "place").drop("_key")


def author_open_works(works: DataFrame, cap: int) -> DataFrame:
    """An author's open works by citations, with the count of all their works."""
    totals = works.groupBy("author").agg(F.count("*").alias("total"))
    is_open = F.col("is_oa") & F.col("oa_url").isNotNull()
    shown = top_k(works.filter(is_open), ["author"], [F.desc("cited_by"), "ord"], cap, "place")
    return shown.join(totals, "author")


def label_fallback(labels: DataFrame, languages: Sequence[str] = ("en", "de")) -> DataFrame:
    """Preferred label of an entity: by language, else the first of any."""
    rank = F.lit(len(languages))
    for i, lang in reversed(list(enumerate(languages))):
        rank = F.when(F.col("lang") == lang, i).otherwise(rank)
    value = F.trim(F.col("value"))
    return (
        labels.filter(value != "")
        .groupBy("qid")
        .agg(F.min(F.struct(rank.alias("r"), "ord", "lang", value.alias("value"))).alias("best"))
        .select("qid", "best.lang", "best.value")
    )


def even_sample(df: DataFrame, lane: str, key: str, size: int) -> DataFrame:
    """``size`` evenly spaced rows per lane by key: of N rows those at the
    positions floor(i*N/size). Smaller lanes are kept whole."""
    sizes = df.groupBy(lane).agg(F.count("*").alias("_all"))
    ranked = rank_within(df, [lane], [key], "_pos").withColumn("_pos", F.col("_pos") - 1)
    # the smallest i whose position is not before this row
    i = F.expr(f"(_pos * {size} + _all - 1) div _all")
    keep = (F.col("_all") <= size) | (i * F.col("_all") < (F.col("_pos") + 1) * size)
    return ranked.join(sizes, lane).filter(keep).drop("_pos", "_all")


def running_budget_cut(
    files: DataFrame, order: Sequence[str], cap: int, floor: float = 0.8
) -> DataFrame:
    """Oldest rows to drop until what stays is at most ``floor * cap``; none
    while the whole is within ``cap``."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    running = running_sum(files, [], order, "size", "_upto")
    return (
        running.crossJoin(F.broadcast(total))
        .filter(
            (F.col("_total") > cap)
            & (F.col("_upto") - F.col("size") < F.col("_total") - F.lit(cap * floor))
        )
        .drop("_total", "_upto")
    )
