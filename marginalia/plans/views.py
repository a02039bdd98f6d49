"""The domain as views over the given tables. Each view is one SQL text that
runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rows that one task may get of a shuffle. Keys like these shrink so much that the 64 MB up to which Spark merges parts can be GB of rows.
ROWS_A_PART = 1_000_000

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "v_claims": """
SELECT l_orderkey AS qid, concat('P', CAST(l_linenumber AS STRING)) AS property, l_partkey AS value_id,
  CASE l_returnflag WHEN 'A' THEN 'preferred' WHEN 'N' THEN 'normal' ELSE 'deprecated' END AS rank,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS ord
FROM lineitem""",
    "v_sections": """
SELECT o_custkey AS page_id, o_orderkey AS section_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS section_ord
FROM orders""",
    "v_cands": """
SELECT s.page_id, s.section_ord, c.ord, c.value_id AS cand
FROM v_sections s JOIN v_claims c ON c.qid = s.section_id""",
    "v_cites": """
SELECT s.page_id, s.section_ord,
  row_number() OVER (PARTITION BY s.page_id, s.section_ord ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
    l.l_returnflag, l.l_linestatus, l.l_shipdate, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax) AS ord,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_partkey END AS cite_key,
  CASE WHEN l.l_linenumber <> 7 AND l.l_returnflag <> 'R' THEN l.l_partkey END AS isbn,
  CASE WHEN l.l_linenumber <> 7 AND l.l_returnflag = 'R' THEN l.l_partkey END AS doi,
  l.l_linestatus = 'O' AS has_url,
  l.l_suppkey % 10 = 0 AS key_failed,
  CASE p.p_size % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'borrow' WHEN 2 THEN 'catalog' END AS volume,
  p.p_name AS title, p.p_brand AS source, p.p_size <= 25 AS licensed, p.p_size % 3 > 0 AS has_image
FROM lineitem l JOIN v_sections s ON s.section_id = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "v_holdings": """
SELECT p_partkey AS id, p_brand AS partner, p_name AS title, p_size AS editions,
  CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS institution, p_size <= 25 AS public_domain,
  CASE WHEN p_size % 3 > 0 THEN concat('http://img.example/', CAST(p_partkey AS STRING)) END AS image_url,
  CASE WHEN p_size % 7 > 0 THEN concat('http://obj.example/', CAST(p_partkey AS STRING)) END AS href
FROM part""",
    "v_class": """
SELECT p_partkey AS child, CAST(floor(p_partkey / 2.0) AS BIGINT) AS parent
FROM part WHERE p_partkey > 0""",
    "v_edges": """
SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS dst,
  l_linestatus AS type, l_returnflag AS system
FROM lineitem GROUP BY l_suppkey, l_partkey, l_linestatus, l_returnflag""",
    "v_geo": """
SELECT c_custkey AS qid, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS lon,
  CAST((c_custkey * 17) % 170 - 85 AS DOUBLE) AS lat
FROM customer""",
    "v_requests": """
SELECT event_id, user_id AS host, ts, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status,
  CASE WHEN value < 250 THEN CAST(floor(value * 10) AS BIGINT) END AS retry_after_s, value AS duration_s
FROM events""",
    "v_pages": """
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, html
FROM pages""",
    "v_docs": "SELECT doc_id, text, lang, source, n_chars FROM documents",
}

_NEEDS = {"v_cands": ("v_sections", "v_claims"), "v_cites": ("v_sections",)}


def with_views(*names: str) -> str:
    """WITH clause that defines the named views (and what they build on)."""
    order: list[str] = []
    for name in names:
        for part in (*_NEEDS.get(name, ()), name):
            if part not in order:
                order.append(part)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _used(sql: str) -> list[str]:
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [t for t in TABLES if t in words]


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """How many parts a shuffle of a table's rows needs for ROWS_A_PART in each; None where the session's number is enough."""
    parts = -(-table(spark, sf_dir, name).count() // ROWS_A_PART)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def sql_over(spark: SparkSession, sf_dir: str, sql: str, *views: str, dealt: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """A SELECT over the given tables and views, as one Catalyst plan. ``dealt``: tables and the column by which each
    goes to ``parts`` parts, if that is a number; joins on the column then have as many."""
    texts: dict[str, str] = {}
    for name in views:
        for part in (*_NEEDS.get(name, ()), name):
            texts.setdefault(part, VIEWS[part])
    everything = " ".join([sql, *texts.values()])
    hints = {t: f"/*+ REPARTITION({parts}, {column}) */ " for t, column in (dealt or {}).items() if parts}
    tables = {t: f"SELECT {hints.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`" for t in _used(everything)}
    ctes = ",\n".join(f"{n} AS ({text})" for n, text in {**tables, **texts}.items())
    return spark.sql(f"WITH {ctes}\n{sql}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql_over(spark, sf_dir, f"SELECT * FROM {name}", name)
