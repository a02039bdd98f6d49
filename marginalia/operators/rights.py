"""Copyright statements folded per item, and what they say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.licences import (
    code_from_label,
    code_from_slug,
    code_from_uri,
    jurisdiction_code,
    licence_marks,
    licence_rank,
    status_struct,
)
from marginalia.operators.graph import descendants


def classify_licenses(df: DataFrame, uri: Column, slug: Column, label: Column) -> DataFrame:
    """Adds licence, licence_rank and licence_marks: by URI, else slug, else
    label; what none of them recognises stays null."""
    code = F.coalesce(code_from_uri(uri), code_from_slug(slug), code_from_label(label))
    return df.withColumn("licence", code).withColumns(
        {"licence_rank": licence_rank(F.col("licence")), "licence_marks": licence_marks(F.col("licence"))}
    )


def license_census(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "licence").agg(F.count("*").alias("n"))


def rights_record(rows: DataFrame) -> DataFrame:
    """One record per item from statement rows (item, ord, status, jurisdiction,
    how, licence_label, creator, creator_status, self_status).

    work: distinct (status, jurisdiction), each with the first method stated;
    licences: distinct codes; creator and self: the first recognised. Items
    about which no row says anything known are left out."""
    read = rows.select(
        "item", "ord", "jurisdiction", "how", "creator",
        status_struct(F.col("status")).alias("work_status"),
        status_struct(F.col("creator_status")).alias("creator_status"),
        status_struct(F.col("self_status")).alias("self_status"),
    )
    known = F.col("work_status").isNotNull()
    # Statuses and jurisdictions are closed lists, so each item's arrays are
    # short once the rows are reduced to one per (status, jurisdiction).
    work = (
        read.filter(known)
        .groupBy("item", "work_status", "jurisdiction")
        .agg(
            F.min("ord").alias("ord"),
            F.min(F.when(F.col("how").isNotNull(), F.struct("ord", "how"))).alias("_how"),
        )
        .groupBy("item")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("ord", F.col("work_status").alias("status"), "jurisdiction", F.col("_how.how").alias("how"))
                )
            ).alias("work")
        )
    )
    # A label that names nothing is left out when the list is made: a filter on
    # what was read would have every label read once more before the grouping.
    licences = (
        rows.filter("licence_label IS NOT NULL")
        .select("item", "ord", code_from_label(F.col("licence_label")).alias("licence"))
        .groupBy("item", "licence")
        .agg(F.min("ord").alias("ord"))
        .groupBy("item")
        .agg(F.array_sort(F.collect_list(F.when(F.col("licence").isNotNull(), F.struct("ord", "licence")))).alias("licences"))
        .select("item", F.when(F.size("licences") > 0, F.col("licences")).alias("licences"))
    )
    people = read.groupBy("item").agg(
        F.min(
            F.when(F.col("creator_status").isNotNull(), F.struct("ord", F.col("creator_status").alias("status"), "creator"))
        ).alias("creator"),
        F.min(F.when(F.col("self_status").isNotNull(), F.struct("ord", F.col("self_status").alias("status")))).alias("self"),
    )
    joined = people.join(work, "item", "left").join(licences, "item", "left")
    something = (
        F.col("work").isNotNull() | F.col("licences").isNotNull()
        | F.col("creator").isNotNull() | F.col("self").isNotNull()
    )
    return joined.filter(something).select("item", "work", "licences", "creator", "self")


def rights_summary(rights: DataFrame) -> DataFrame:
    """What a reader may conclude: leading status and licence, whether the
    work is free, bound or mixed, where, and whether the only thing recorded
    is that the question is open."""
    def lead(of: str) -> Column:
        ranked = F.array_sort(
            F.transform(
                of,
                lambda w: F.struct(
                    w["status"]["rank"].alias("rank"), w["ord"].alias("ord"),
                    w["status"]["code"].alias("code"), w["status"]["marks"].alias("marks"),
                ),
            )
        )
        return F.get(ranked, F.lit(0))

    def places(of: str) -> Column:
        named = F.array_distinct(
            F.filter(F.transform(of, lambda w: jurisdiction_code(w["jurisdiction"])), lambda p: p.isNotNull())
        )
        short_first = F.array_sort(F.transform(named, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
        return F.array_join(F.transform(short_first, lambda s: s["p"]), "; ")

    best_licence = F.get(
        F.array_sort(
            F.transform(
                "licences",
                lambda x: F.struct(
                    licence_rank(x["licence"]).alias("rank"), x["ord"].alias("ord"), x["licence"].alias("code")
                ),
            )
        ),
        F.lit(0),
    )

    def some(of: str) -> Column:
        return F.coalesce(F.size(of) > 0, F.lit(False))

    # Each intermediate list is a column of its own, so it is computed once.
    split = rights.select(
        "item",
        F.filter("work", lambda w: w["status"]["known"]).alias("known"),
        F.filter("work", lambda w: w["status"]["known"] & w["status"]["free"]).alias("free"),
        F.filter("work", lambda w: w["status"]["known"] & ~w["status"]["free"]).alias("bound"),
        F.filter("work", lambda w: ~w["status"]["known"]).alias("open"),
        best_licence.alias("licence"),
        F.coalesce("creator.status", "self.status").alias("person"),
    ).withColumn("lead", lead("known"))
    nothing_known = ~some("known") & F.col("licence").isNull() & F.col("person").isNull()
    licence_leads = F.col("licence").isNotNull() & (
        F.col("lead").isNull() | (F.col("licence.rank") <= F.col("lead.rank"))
    )
    return split.select(
        "item",
        F.col("lead.code").alias("lead_status"),
        F.col("licence.code").alias("lead_licence"),
        F.col("person.code").alias("creator_status"),
        some("free").alias("free"),
        some("bound").alias("bound"),
        (some("free") & some("bound")).alias("mixed"),
        places("free").alias("free_in"),
        places("bound").alias("bound_in"),
        (nothing_known & some("open")).alias("open_question"),
        F.when(licence_leads, licence_marks(F.col("licence.code")))
        .otherwise(F.coalesce("lead.marks", "person.marks"))
        .alias("marks"),
    )


def attach_rights(entries: DataFrame, rights: DataFrame) -> DataFrame:
    """Rulings stamped on entries. On the subject's own works the creator's
    ruling stands unless the copy at hand says otherwise (a loan is not a free
    copy) or its source does not name a sole author; on anchor cards the
    work's own ruling stands. ``entries``: item (whose ruling applies), route,
    copy_code, loan_code, trusts_creator; ``rights``: item, creator_ruling,
    work_ruling."""
    own = F.col("route") == "own-work"
    ruling = (
        F.when(own & F.col("loan_code").isNotNull(), F.lit(None))
        .when(own & F.coalesce("trusts_creator", F.lit(True)), F.col("creator_ruling"))
        .when(F.col("route") == "anchor", F.col("work_ruling"))
    )
    copy = F.when(own & F.col("loan_code").isNotNull(), F.col("loan_code")).otherwise(F.col("copy_code"))
    return (
        entries.join(rights, "item", "left")
        .withColumn("rights_copy", copy)
        .withColumn("rights_work", ruling)
        .drop("creator_ruling", "work_ruling")
    )


def class_verdicts(
    edges: DataFrame,
    item_classes: DataFrame,
    ended: DataFrame,
    locatable: DataFrame,
    historical: DataFrame,
) -> DataFrame:
    """Per item: is it a place, is it defunct. A class is judged once, by its
    ancestors, whose marks come down the ``edges`` (child, parent); an item by any of its classes or by a stated end. An item
    without a class is neither."""
    roots = locatable.select("class", F.lit("place").alias("mark")).unionByName(historical.select("class", F.lit("past").alias("mark")))
    verdicts = descendants(edges, roots).groupBy("class").agg(
        F.bool_or(F.col("mark") == "place").alias("_place"), F.bool_or(F.col("mark") == "past").alias("_past")
    )
    judged = item_classes.join(verdicts, "class", "left").groupBy("item").agg(
        F.count("class").alias("_classes"),
        F.coalesce(F.bool_or("_place"), F.lit(False)).alias("place"),
        F.coalesce(F.bool_or("_past"), F.lit(False)).alias("_past"),
    )
    over = ended.select("item").distinct().withColumn("_ended", F.lit(True))
    return judged.join(over, "item", "left").select(
        "item",
        "place",
        ((F.col("_classes") > 0) & (F.col("_past") | F.coalesce("_ended", F.lit(False)))).alias("defunct"),
    )
