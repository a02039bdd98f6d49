"""Page-wide ownership: units in order take what no earlier unit took.

Taking turns in order is the stable assignment in which every key prefers the
earliest unit and every unit its own order, and that assignment is unique; so
it is found by rounds of joins, whatever the size of a page. In a round each unit names its first ``cap`` open keys; each key keeps
to the earliest unit that names it, and later units lose it for good. When a
round takes nothing away, what is named is what is owned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.ordering import top_k
from marginalia.session import cut_lineage

def claim_anchors(
    cands: DataFrame, per_unit: int, seeds: DataFrame | None = None
) -> DataFrame:
    """Sections in order take up to ``per_unit`` candidates that no earlier
    section owns. Repeats within a section collapse before the cap. A seeded
    candidate is open to its owner alone.

    ``cands``: page_id, section_ord, ord, cand; ``seeds``: page_id, cand, owner."""
    rows = cands.filter("cand IS NOT NULL")
    if seeds is not None:
        rows = (
            rows.join(seeds, ["page_id", "cand"], "left")
            .filter("owner IS NULL OR owner = section_ord")
            .drop("owner")
        )
    once = rows.groupBy("page_id", "section_ord", "cand").agg(F.min("ord").alias("ord"))
    return _claim(once, "cand", per_unit)


def claim_citations(cites: DataFrame, cap: int | None) -> DataFrame:
    """The same for cited works (``cite_key``): one without a key is always
    shown while the section has room, and owns nothing. Without a cap every
    work is shown where it is first cited."""
    keyed = cites.filter("cite_key IS NOT NULL")
    keyless = cites.filter("cite_key IS NULL")
    if cap is None:
        first = top_k(keyed, ["page_id", "cite_key"], ["section_ord", "ord"])
        return first.unionByName(keyless).select("page_id", "section_ord", "ord", "cite_key")
    once = keyed.groupBy("page_id", "section_ord", "cite_key").agg(F.min("ord").alias("ord"))
    rows = once.unionByName(keyless.select(*once.columns))
    return _claim(rows, "cite_key", cap)


def _claim(rows: DataFrame, key: str, cap: int) -> DataFrame:
    rows = rows.select("page_id", "section_ord", "ord", key)
    live = cut_lineage(rows)
    left = live.count()
    while True:
        named = top_k(live, ["page_id", "section_ord"], ["ord"], cap)
        owners = (
            named.filter(F.col(key).isNotNull())
            .groupBy("page_id", key)
            .agg(F.min("section_ord").alias("_owner"))
        )
        live = cut_lineage(
            live.join(owners, ["page_id", key], "left")
            .filter("_owner IS NULL OR section_ord <= _owner")
            .drop("_owner")
        )
        now = live.count()
        if now == left:
            return top_k(live, ["page_id", "section_ord"], ["ord"], cap).select(*rows.columns)
        left = now
