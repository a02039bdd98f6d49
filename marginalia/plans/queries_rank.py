"""Orders, budgets, picks and ownership over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import ownership as O
from marginalia.operators import ranking as K
from marginalia.plans.catalog import query
from marginalia.plans.views import sql_over, table, view, with_views


@query(
    "best_rank_values",
    f"""{with_views('v_claims')}
SELECT qid, property, value_id, rank, ord FROM (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY qid, property) AS p FROM v_claims)
WHERE rank = 'preferred' OR (rank = 'normal' AND NOT p)""",
)
def best_rank_values(spark, sf):
    return K.best_rank_values(view(spark, sf, "v_claims"))


CLASSES = "SELECT p_partkey AS class, p_type AS medium FROM part WHERE p_size <= 10"


@query(
    "work_class",
    f"""{with_views('v_claims')}, c AS ({CLASSES}),
b AS (SELECT * FROM (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY qid) AS p FROM v_claims WHERE property = 'P1')
  WHERE rank = 'preferred' OR (rank = 'normal' AND NOT p))
SELECT qid, arg_min(medium, ord) AS medium FROM b JOIN c ON class = value_id GROUP BY qid""",
)
def work_class(spark, sf):
    return K.work_class(view(spark, sf, "v_claims"), sql_over(spark, sf, CLASSES), "P1")


@query(
    "subject_anchors",
    f"""{with_views('v_claims')}
SELECT qid, value_id, CAST(min(CASE WHEN property IN ('P1', 'P2') THEN 0 ELSE 1 END) AS BIGINT) AS rank FROM v_claims GROUP BY 1, 2""",
)
def subject_anchors(spark, sf):
    return K.subject_anchors(view(spark, sf, "v_claims"), naming=("P1", "P2"))


STATEMENTS = """SELECT id AS qid, image_url AS met, href AS lc FROM v_holdings"""


@query(
    "hook_tier",
    f"""{with_views('v_holdings', 'v_cands')},
a AS (SELECT DISTINCT page_id, cand FROM v_cands),
t AS (SELECT page_id, CASE WHEN image_url IS NOT NULL THEN 0 WHEN href IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM a LEFT JOIN v_holdings ON id = cand),
c AS (SELECT page_id, tier, count(*) AS anchors FROM t GROUP BY 1, 2)
SELECT page_id, CAST(tier AS BIGINT) AS tier, anchors,
  CAST(anchors AS DOUBLE) / CAST(sum(anchors) OVER (PARTITION BY page_id) AS DOUBLE) AS share FROM c""",
)
def hook_tier(spark, sf):
    anchors = view(spark, sf, "v_cands").select("page_id", F.col("cand").alias("qid")).distinct()
    _, profile = K.hook_tier(sql_over(spark, sf, STATEMENTS, "v_holdings"), anchors)
    return profile


TIERS = """SELECT p_partkey AS cand, CASE WHEN p_size % 3 > 0 THEN 0 WHEN p_size % 7 > 0 THEN 1 ELSE 2 END AS tier FROM part"""
# What a page's own entity names: the parts of its customer's first order.
RELATED = """SELECT page_id, value_id AS cand, min(CASE WHEN property IN ('P1', 'P2') THEN 0 ELSE 1 END) AS related
FROM v_sections JOIN v_claims ON qid = section_id WHERE section_ord = 2 GROUP BY 1, 2"""


@query(
    "order_candidates",
    f"""{with_views('v_cands', 'v_claims')}, t AS ({TIERS}), r AS ({RELATED})
SELECT c.page_id, c.section_ord, c.ord, c.cand, row_number() OVER (PARTITION BY c.page_id, c.section_ord
  ORDER BY CASE WHEN c.section_ord = 1 THEN coalesce(r.related, 2) ELSE 0 END, coalesce(t.tier, 2), c.ord) AS place
FROM v_cands c LEFT JOIN t ON t.cand = c.cand LEFT JOIN r ON r.page_id = c.page_id AND r.cand = c.cand""",
)
def order_candidates(spark, sf):
    return K.order_candidates(
        view(spark, sf, "v_cands"),
        sql_over(spark, sf, RELATED, "v_sections", "v_claims"),
        sql_over(spark, sf, TIERS),
    )


def _serial(rows: str, key: str, cap: int) -> str:
    """Recursive form of taking turns: one candidate at a time, in order. The
    claimed keys travel as a list per page, which is fine for short pages."""
    return f"""q AS (SELECT page_id, section_ord, ord, {key} AS k, row_number() OVER (PARTITION BY page_id ORDER BY section_ord, ord) AS rn FROM ({rows})),
w AS (SELECT page_id, 0::BIGINT AS rn, NULL::BIGINT AS section_ord, NULL::BIGINT AS ord, NULL::BIGINT AS k, 0 AS taken, false AS takes, []::BIGINT[] AS owned
  FROM (SELECT DISTINCT page_id FROM q)
 UNION ALL
 SELECT page_id, rn, section_ord, ord, k, before + takes::INT, takes, CASE WHEN takes AND k IS NOT NULL THEN list_append(owned, k) ELSE owned END FROM (
  SELECT q.page_id, q.rn, q.section_ord, q.ord, q.k, w.owned, CASE WHEN w.section_ord = q.section_ord THEN w.taken ELSE 0 END AS before,
    (CASE WHEN w.section_ord = q.section_ord THEN w.taken ELSE 0 END) < {cap} AND (q.k IS NULL OR NOT list_contains(w.owned, q.k)) AS takes
  FROM w JOIN q ON q.page_id = w.page_id AND q.rn = w.rn + 1))"""


SEEDS = "SELECT page_id, cand, min(section_ord) AS owner FROM v_cands WHERE ord = 1 AND section_ord = 2 GROUP BY 1, 2"


@query(
    "claim_anchors",
    f"""{with_views('v_cands').replace('WITH', 'WITH RECURSIVE', 1)}, s AS ({SEEDS}),
{_serial('''SELECT c.page_id, c.section_ord, min(c.ord) AS ord, c.cand FROM v_cands c LEFT JOIN s ON s.page_id = c.page_id AND s.cand = c.cand
  WHERE s.owner IS NULL OR s.owner = c.section_ord GROUP BY 1, 2, 4''', 'cand', 2)}
SELECT page_id, section_ord, ord, k AS cand FROM w WHERE takes""",
)
def claim_anchors(spark, sf):
    seeds = sql_over(spark, sf, SEEDS, "v_cands")
    return O.claim_anchors(view(spark, sf, "v_cands"), 2, seeds)


@query(
    "claim_citations",
    f"""{with_views('v_cites').replace('WITH', 'WITH RECURSIVE', 1)},
{_serial('''SELECT page_id, section_ord, min(ord) AS ord, cite_key FROM v_cites WHERE cite_key IS NOT NULL GROUP BY 1, 2, 4
  UNION ALL SELECT page_id, section_ord, ord, cite_key FROM v_cites WHERE cite_key IS NULL''', 'cite_key', 3)}
SELECT page_id, section_ord, ord, k AS cite_key FROM w WHERE takes""",
)
def claim_citations(spark, sf):
    return O.claim_citations(view(spark, sf, "v_cites"), 3)


@query(
    "claim_citations_uncapped",
    f"""{with_views('v_cites')}
SELECT page_id, section_ord, ord, cite_key FROM v_cites WHERE cite_key IS NULL OR (section_ord, ord) = (
  SELECT min((x.section_ord, x.ord)) FROM v_cites x WHERE x.page_id = v_cites.page_id AND x.cite_key = v_cites.cite_key)""",
)
def claim_citations_uncapped(spark, sf):
    return O.claim_citations(view(spark, sf, "v_cites"), None)


@query(
    "prefer_open",
    f"""{with_views('v_cites')}
SELECT page_id, section_ord, ord, source, CAST(CASE WHEN licensed THEN 0 ELSE 1 END AS BIGINT) AS open_rank,
  row_number() OVER (PARTITION BY page_id, section_ord ORDER BY CASE WHEN licensed THEN 0 ELSE 1 END, ord) AS place
FROM v_cites WHERE volume IS NOT NULL AND NOT key_failed
UNION ALL SELECT page_id, section_ord, ord, source, NULL, NULL FROM v_cites WHERE volume IS NOT NULL AND key_failed""",
)
def prefer_open(spark, sf):
    papers = view(spark, sf, "v_cites").select(
        "page_id", "section_ord", "ord", "source", "licensed",
        F.col("volume").isNotNull().alias("found"), F.col("key_failed").alias("retracted"),
    )
    return K.prefer_open(papers).drop("licensed", "found", "retracted")


@query(
    "rank_citations",
    f"""{with_views('v_cites')}, k AS (SELECT page_id, section_ord, ord,
  CASE WHEN isbn IS NOT NULL THEN 0 WHEN has_url THEN 1 ELSE 2 END AS kind_rank FROM v_cites),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY kind_rank, ord) AS place FROM k)
SELECT * FROM r WHERE place <= 3""",
)
def rank_citations(spark, sf):
    cites = view(spark, sf, "v_cites").select(
        "page_id", "section_ord", "ord", "isbn", F.when(F.col("has_url"), F.lit("archived")).alias("archive_url")
    )
    return K.rank_citations(cites, K.book_archive_rest(), 3).drop("isbn", "archive_url")


@query(
    "card_budgets",
    f"""{with_views('v_cites')},
m AS (SELECT *, CASE WHEN volume = 'full' THEN row_number() OVER (PARTITION BY page_id, section_ord, volume = 'full' ORDER BY ord) END AS map_no FROM v_cites),
k AS (SELECT page_id, section_ord, ord, volume = 'full' AS is_map, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY ord) AS place
  FROM m WHERE map_no IS NULL OR map_no <= 1)
SELECT page_id, section_ord, ord, place, coalesce(is_map, false) AS is_map FROM k WHERE place <= 4""",
)
def card_budgets(spark, sf):
    cards = view(spark, sf, "v_cites").select(
        "page_id", "section_ord", "ord", F.col("ord").alias("anchor_ord"),
        F.coalesce(F.col("volume") == "full", F.lit(False)).alias("is_map"),
    )
    return K.card_budgets(cards, 4, 1).drop("anchor_ord")


STANDING = """CASE WHEN volume = 'full' THEN 'subject-document' WHEN volume = 'borrow' THEN 'subject-record'
  WHEN volume = 'catalog' THEN 'subject-work' END"""
PROSE = "SELECT page_id, section_ord, CAST(sum(length(title)) * 20 AS BIGINT) AS prose_chars FROM v_cites GROUP BY 1, 2"


@query(
    "pick_hero",
    f"""{with_views('v_cites')}, p AS ({PROSE}),
r AS (SELECT *, {STANDING} AS standing FROM v_cites),
h AS (SELECT *, CASE WHEN standing = 'subject-document' THEN 0 WHEN standing = 'subject-record' AND has_image THEN 1
  WHEN standing = 'subject-record' THEN 2 WHEN standing = 'subject-work' THEN 3
  WHEN has_image THEN 4 ELSE 6 END AS hero_rank FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY hero_rank, ord) AS rn FROM h)
SELECT page_id, section_ord, ord, CAST(hero_rank AS BIGINT) AS hero_rank, prose_chars FROM f JOIN p USING (page_id, section_ord)
WHERE rn = 1 AND (has_image OR coalesce(standing = 'subject-document', false)) AND prose_chars >= 700""",
)
def pick_hero(spark, sf):
    entries = sql_over(
        spark, sf,
        f"SELECT page_id, section_ord, ord, source, has_image AS visual, {STANDING} AS standing FROM v_cites", "v_cites",
    )
    hero, _ = K.pick_hero(entries, sql_over(spark, sf, PROSE, "v_cites"))
    return hero.select("page_id", "section_ord", "ord", "hero_rank", "prose_chars")


HEADING = "red plates and the old widget of 1998"


@query(
    "rank_shelf",
    f"""{with_views('v_holdings')},
s AS (SELECT partner, id, title, 2 * len(list_filter(list_distinct(list_transform(string_split(lower(title), ' '),
    lambda w: CASE WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END)),
    lambda w: list_contains(['red', 'plate', 'old', 'widget'], w)))
  + (image_url IS NOT NULL)::INT AS score FROM v_holdings),
d AS (SELECT *, row_number() OVER (PARTITION BY partner, title ORDER BY score DESC, id) AS n FROM s),
r AS (SELECT partner, id, title, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY partner ORDER BY score DESC, id) AS place FROM d WHERE n = 1)
SELECT * FROM r WHERE place <= 4""",
)
def rank_shelf(spark, sf):
    entries = view(spark, sf, "v_holdings").select(
        "partner", "id", F.col("id").alias("ord"), "title", "image_url",
        F.lit(HEADING).alias("heading"), F.lit("").alias("anchor_label"),
    )
    return K.rank_shelf(entries, ["partner"], 4).select("partner", "id", "title", "score", "place")


WORKS = """SELECT value_id AS subject, qid AS work, property AS museum, CAST(substr(property, 2) AS INT) AS museum_ord,
  min(qid) % 2 = 0 AS sitelink FROM v_claims GROUP BY value_id, qid, property"""


def _round_robin(cap: int) -> str:
    """Turns as rows: in turn t a museum takes its first work nobody took."""
    return f"""mus AS (SELECT subject, museum, museum_ord, row_number() OVER (PARTITION BY subject ORDER BY museum_ord) AS m,
    count(*) OVER (PARTITION BY subject) AS ms FROM (SELECT DISTINCT subject, museum, museum_ord FROM works)),
queue AS (SELECT subject, museum, list(work ORDER BY sitelink DESC, work) AS q FROM works GROUP BY 1, 2),
turn AS (SELECT subject, museum, q, (round - 1) * ms + m AS t, ms * {cap} AS last FROM mus JOIN queue USING (subject, museum), range(1, {cap} + 1) AS r(round)),
go AS (SELECT subject, 0::BIGINT AS t, NULL::VARCHAR AS museum, NULL::BIGINT AS work, []::BIGINT[] AS taken FROM (SELECT DISTINCT subject FROM works)
 UNION ALL
 SELECT subject, t, museum, work, CASE WHEN work IS NULL THEN taken ELSE list_append(taken, work) END FROM (
  SELECT turn.subject, turn.t, turn.museum, go.taken,
    CASE WHEN len(go.taken) < {cap} THEN list_filter(turn.q, lambda x: NOT list_contains(go.taken, x))[1] END AS work
  FROM go JOIN turn ON turn.subject = go.subject AND turn.t = go.t + 1))"""


@query(
    "pick_diverse",
    f"""{with_views('v_claims').replace('WITH', 'WITH RECURSIVE', 1)}, works AS ({WORKS}), {_round_robin(6)}
SELECT subject, CAST(len(taken) AS BIGINT) AS place, work, museum FROM go WHERE work IS NOT NULL""",
)
def pick_diverse(spark, sf):
    return K.pick_diverse(sql_over(spark, sf, WORKS, "v_claims"), 6)


@query(
    "dedupe_shards",
    f"""{with_views('v_holdings')},
d AS (SELECT *, row_number() OVER (PARTITION BY partner, title ORDER BY editions DESC, id) AS n FROM v_holdings),
r AS (SELECT partner AS author, id, title, editions, row_number() OVER (PARTITION BY partner ORDER BY (image_url IS NOT NULL) DESC, id) AS place FROM d WHERE n = 1)
SELECT * FROM r WHERE place <= 12""",
)
def dedupe_shards(spark, sf):
    works = view(spark, sf, "v_holdings").select(
        F.col("partner").alias("author"), "id", F.col("id").alias("ord"), "title", "editions",
        F.col("image_url").isNotNull().alias("has_image"),
    )
    return K.dedupe_shards(works, 12).drop("ord", "has_image")


@query(
    "author_open_works",
    f"""{with_views('v_cites')}, x AS (SELECT *, count(*) OVER (PARTITION BY source) AS total FROM v_cites),
r AS (SELECT source AS author, page_id, section_ord, ord, total, row_number() OVER (PARTITION BY source ORDER BY page_id DESC, section_ord, ord) AS place
  FROM x WHERE has_url AND licensed)
SELECT * FROM r WHERE place <= 6""",
)
def author_open_works(spark, sf):
    works = view(spark, sf, "v_cites").select(
        F.col("source").alias("author"), F.col("page_id").alias("cited_by"), "page_id", "section_ord",
        F.struct("section_ord", F.col("ord").alias("o")).alias("ord"),
        F.col("has_url").alias("is_oa"), F.when(F.col("licensed"), F.lit("url")).alias("oa_url"),
    )
    return K.author_open_works(works, 6).select("author", "page_id", "section_ord", F.col("ord.o").alias("ord"), "total", "place")


@query(
    "label_fallback",
    """SELECT source AS qid, arg_min(lang, (CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id)) AS lang,
  arg_min(trim(text), (CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id)) AS value
FROM documents WHERE trim(text) <> '' GROUP BY source""",
)
def label_fallback(spark, sf):
    labels = table(spark, sf, "documents").select(
        F.col("source").alias("qid"), "lang", F.col("text").alias("value"), F.col("doc_id").alias("ord")
    )
    return K.label_fallback(labels)


@query(
    "even_sample",
    f"""{with_views('v_holdings')},
r AS (SELECT partner, id, row_number() OVER (PARTITION BY partner ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY partner) AS n FROM v_holdings)
SELECT partner, id FROM r WHERE n <= 9 OR pos IN (SELECT CAST(floor(i * r.n / 9.0) AS BIGINT) FROM range(0, 9) AS t(i))""",
)
def even_sample(spark, sf):
    return K.even_sample(view(spark, sf, "v_holdings").select("partner", "id"), "partner", "id", 9)


@query(
    "running_budget_cut",
    """WITH f AS (SELECT l_partkey AS part_id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS size, max(l_orderkey) AS touched FROM lineitem GROUP BY 1),
r AS (SELECT *, sum(size) OVER (ORDER BY touched, part_id) - size AS before, sum(size) OVER () AS total FROM f)
SELECT part_id, size, touched FROM r WHERE total > 20000 AND before < total - 16000""",
)
def running_budget_cut(spark, sf):
    files = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("size"), F.max("l_orderkey").alias("touched")
    )
    return K.running_budget_cut(files, ["touched", "part_id"], 20_000)
