"""Secrets in text: known forms by pattern, unknown ones by the entropy of sliding windows. DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 16
# A maximal run is found by its least length as well as by any length.
HEX = r"[0-9a-f]{32,}"
VALUE_LENGTH = 8
KINDS = ("assign", "access", "hex", "entropy")

# Candidate strings: runs of key characters, of any length.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WIDTH = 20
# Character classes: alphabet and the entropy in bits that a window of 20 characters must exceed.
CLASSES = {"hex": ("0123456789abcdef", 2.75), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.55)}
# Allowed although they look random: words and numbers alone, paths and slugs of words, identifiers in standard form, sample keys.
ALLOWED = (
    r"^[A-Za-z_/+-]*$|^[0-9_/+-]*$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^(?:[A-Za-z]+|[0-9]+)(?:[-_/+](?:[A-Za-z]+|[0-9]+))+$"
    r"|^(?:sha(?:1|256|384|512)|md5)[-_/+]"
    r"|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]"
)

_SPAN = "struct<start:int,kind:int,end:int,held:string>"


def _weight(count: Column) -> Column:
    """count · log2(count), exactly nothing for 0 and 1."""
    return F.when(count <= 1, F.lit(0.0)).otherwise(count * F.log2(count.cast("double")))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """The leftmost non-overlapping matches as structs of start, end (code points, end exclusive), kind and what is matched:
    the pieces between matches and the matches themselves alternate, so lengths add up to places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(both: Column) -> Column:
        pieces, held = both["pieces"], both["held"]
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["piece"])
            end = start + F.length(pair["held"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["held"].alias("held"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(held)), held, lambda p, h: F.struct(p.alias("piece"), h.alias("held")))
        return F.aggregate(pairs, zero, step, lambda s: s["out"])

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), found.alias("held"))
    out = F.get(F.transform(F.array(both), placed), F.lit(0))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(f"array<{_SPAN}>"))


def window_stretches(text: Column, alphabet: str, least_bits: float, width: int = WIDTH) -> Column:
    """The stretches (structs of start, end) of ``text`` that its windows whose entropy exceeds ``least_bits`` cover; windows
    that touch or overlap make one.

    One pass: the state holds the window's count per character and the sum of count·log2(count). A step
    lets one character in and, once the window is full, one out, and changes the sum by these two counts alone.
    The entropy is log2(width) - sum / width."""
    most = width * (math.log2(width) - least_bits)

    def walk(codes: Column) -> Column:
        zero = F.struct(
            F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"),
            F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
            F.array().cast("array<struct<start:int,end:int>>").alias("done"),
        )

        def shifted(counts: Column, at: Column, by: int) -> Column:
            return F.transform(counts, lambda c, k: F.when(k == at, c + by).otherwise(c))

        def step(state: Column, code: Column) -> Column:
            leaving = F.get(codes, state["i"] - width)
            old = F.get(state["counts"], leaving)
            less = F.when(state["i"] >= width, _weight(old - 1) - _weight(old)).otherwise(F.lit(0.0))
            out_of = F.when(state["i"] >= width, shifted(state["counts"], leaving, -1)).otherwise(state["counts"])

            def enter(counts: Column) -> Column:
                new = F.get(counts, code)
                total = state["sum"] + less + _weight(new + 1) - _weight(new)
                end = state["i"] + 1
                high = (end >= width) & (total < F.lit(most))
                apart = high & (state["end"].isNull() | (end - width > state["end"]))
                past = apart & state["end"].isNotNull()
                return F.struct(
                    end.alias("i"), shifted(counts, code, 1).alias("counts"), total.alias("sum"),
                    F.when(apart, end - width).otherwise(state["start"]).alias("start"),
                    F.when(high, end).otherwise(state["end"]).alias("end"),
                    F.when(past, F.array_append(state["done"], F.struct(state["start"].alias("start"), state["end"].alias("end"))))
                    .otherwise(state["done"]).alias("done"),
                )

            return F.get(F.transform(F.array(out_of), enter), F.lit(0))

        def last(s: Column) -> Column:
            return F.when(s["end"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["start"].alias("start"), s["end"].alias("end"))))

        return F.aggregate(codes, zero, step, last)

    codes = F.transform(F.split(text, "(?!^)(?!$)"), lambda ch: F.position(ch, F.lit(alphabet)))
    return F.get(F.transform(F.array(codes), walk), F.lit(0))


def entropy_spans(text: Column, known: Column) -> Column:
    """Spans of kind entropy: in all that known spans leave of a candidate string, if no allowed form covers string or
    piece, every stretch of windows that are too random for the piece's class. ``known`` is sorted by start."""
    low, wide = CLASSES["hex"], CLASSES["base64"]
    kind = "struct<start:int,end:int,held:string>"

    def left(c: Column) -> Column:
        zero = F.struct(c["start"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def piece(start: Column, end: Column) -> Column:
            held = F.substring(c["held"], start - c["start"] + 1, end - start)
            return F.array(F.struct(start.alias("start"), end.alias("end"), held.alias("held")))

        def step(state: Column, k: Column) -> Column:
            out = F.concat(state["out"], piece(state["at"], F.greatest(state["at"], k["start"])))
            return F.struct(F.greatest(state["at"], k["end"]).alias("at"), out.alias("out"))

        touching = F.filter(known, lambda k: (k["start"] < c["end"]) & (k["end"] > c["start"]))
        last = lambda s: F.concat(s["out"], piece(s["at"], F.greatest(s["at"], c["end"])))
        return F.aggregate(touching, zero, step, last)

    def fresh(c: Column) -> Column:
        return (F.length(c["held"]) >= WIDTH) & ~c["held"].rlike(ALLOWED)

    def scanned(c: Column) -> Column:
        found = F.when(c["held"].rlike("^[0-9a-f]*$"), window_stretches(c["held"], *low)).otherwise(window_stretches(c["held"], *wide))
        return F.transform(
            found,
            lambda r: F.struct(
                (c["start"] + r["start"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + r["end"]).alias("end"),
                F.substring(c["held"], r["start"] + 1, r["end"] - r["start"]).alias("held"),
            ),
        )

    pieces = F.flatten(F.transform(F.filter(spans_of(text, CANDIDATE, 3), fresh), left))
    return F.flatten(F.transform(F.filter(pieces, fresh), scanned))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) with n_assign, n_access, n_hex, n_entropy, base_spans and
    secret_spans: arrays of start, kind (place in ``KINDS``), end (code points, end exclusive) and the matched text,
    sorted by start, then kind. Known forms are kept whatever the entropy says; entropy adds spans where none is.

    Null and empty texts have no spans. Columns of those names in ``docs`` are replaced. Rows are judged alone,
    without a shuffle; the window pass takes time in proportion to the length of a candidate string."""
    own = ["n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "secret_spans"]
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["held"], ASSIGN, 2)) >= VALUE_LENGTH)
    access = F.when(text.contains("AKIA"), spans_of(text, ACCESS, 1)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    access = F.filter(access, lambda s: s["end"] - s["start"] >= ACCESS_LENGTH)
    base = F.concat(assign, access, spans_of(text, HEX, 2))
    df = docs.drop(*own).withColumn("base_spans", F.sort_array(base))
    df = df.withColumn("secret_spans", F.sort_array(F.concat("base_spans", entropy_spans(text, F.col("base_spans")))))
    counts = {f"n_{kind}": _count(F.col("secret_spans"), k) for k, kind in enumerate(KINDS)}
    return df.withColumns(counts)


def redacted_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All documents with the columns of ``docs``; every stretch covered by secret spans is replaced by ``mark``."""

    def cut(text: Column, spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            # A span that starts within the last one only carries it on.
            before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
            parts = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(before, F.lit(mark)))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("out"))

        return F.aggregate(
            spans, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
        )

    df = scan_secrets(docs)
    spans = F.transform("secret_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("_clean", F.when(F.size("secret_spans") > 0, cut(F.col("text"), spans)).otherwise(F.col("text")))
    values = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.size("secret_spans") > 0, F.length("_clean").cast("bigint")).otherwise(F.col("n_chars"))
    return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


def _sql_spans(name: str, kind: int, pattern: str, keep: str, source: str = "secret_docs") -> str:
    p = pattern.replace("'", "''")
    return f"""
{name}_parts AS (SELECT doc_id, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS held
  FROM {source} WHERE regexp_matches(text, '{p}')),
{name}_rows AS (SELECT doc_id, i, pieces[i] AS piece, held[i] AS held FROM (
  SELECT *, unnest(range(1, len(held) + 1)) AS i FROM {name}_parts)),
{name} AS (SELECT doc_id, {kind} AS kind, held, (sum(length(piece) + length(held)) OVER w)::BIGINT AS e,
  (sum(length(piece) + length(held)) OVER w)::BIGINT - length(held) AS s FROM {name}_rows WINDOW w AS (PARTITION BY doc_id ORDER BY i)
  QUALIFY {keep})"""


#: Over a relation ``documents``; also a stage of the pipeline.
SECRETS_CTE = (
    "secret_docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + _sql_spans("found_assign", 0, ASSIGN, f"length(regexp_extract(held, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8") + ","
    + _sql_spans("found_access", 1, ACCESS, "length(held) >= 16") + ","
    + _sql_spans("found_hex", 2, "[0-9a-f]{32,}", "true") + ","
    + _sql_spans("found_run", 3, "[A-Za-z0-9+/_-]{20,}", "true") + f""",
found_base AS (SELECT * FROM found_assign UNION ALL SELECT * FROM found_access UNION ALL SELECT * FROM found_hex),
fresh_runs AS (SELECT * FROM found_run WHERE NOT regexp_matches(held, '{ALLOWED}')),
run_cuts AS (SELECT r.doc_id, r.s AS rs, r.held, b.s, b.e FROM fresh_runs r JOIN found_base b ON b.doc_id = r.doc_id AND b.s < r.e AND b.e > r.s
  UNION ALL SELECT doc_id, s, held, e, e FROM fresh_runs),
run_gaps AS (SELECT doc_id, rs, held, s AS until, greatest(rs, coalesce(max(e) OVER (PARTITION BY doc_id, rs ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rs)) AS since FROM run_cuts),
run_pieces AS (SELECT doc_id, since AS s, substring(held, since - rs + 1, until - since) AS held FROM run_gaps WHERE until - since >= {WIDTH}),
fresh_pieces AS (SELECT * FROM run_pieces WHERE NOT regexp_matches(held, '{ALLOWED}')),
run_windows AS (SELECT doc_id, s, i, list_aggregate(string_split(substring(held, i, {WIDTH}), ''), 'entropy') AS bits,
    CASE WHEN regexp_matches(held, '^[0-9a-f]*$') THEN {CLASSES['hex'][1]} ELSE {CLASSES['base64'][1]} END AS least_bits
  FROM (SELECT *, unnest(range(1, length(held) - {WIDTH - 2})) AS i FROM fresh_pieces)),
high_windows AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) > {WIDTH} AS apart FROM run_windows WHERE bits > least_bits),
stretches AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM high_windows),
found_entropy AS (SELECT doc_id, 3 AS kind, min(s + i - 1)::BIGINT AS s, max(s + i - 1 + {WIDTH})::BIGINT AS e
  FROM stretches GROUP BY doc_id, stretches.s, island),
found_all AS (SELECT doc_id, kind, s, e FROM found_base UNION ALL SELECT doc_id, kind, s, e FROM found_entropy),
found_named AS (SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END
    || ':' || s || ':' || e AS shown FROM found_all)"""
)

SECRETS_SQL = f"""WITH {SECRETS_CTE},
counted AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, coalesce(string_agg(shown, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
    coalesce(string_agg(shown, ',' ORDER BY s, kind), '') AS spans FROM found_named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN counted USING (doc_id)"""


@query("op9_scan_secrets", SECRETS_SQL)
def op9_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
    )
