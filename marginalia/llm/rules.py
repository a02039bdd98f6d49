"""Line-first cleaning of web text, in DataFrame operations alone.

Every line is judged by itself on its punctuation, on signs of navigation and
on boilerplate wording. Failing lines are removed; a document that loses too
much of its text that way is rejected, as is one that is too short or repeats itself."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
MAX_LOST = 0.5  # of a document's words

# Punctuation: a line of text ends like a sentence, and is not strewn with symbols or exclamation marks.
ENDS, CLOSERS = ".!?…。！？:;", "\"'”’»)]*_"
STREWN = r"(?:[#*$%&|<>]{2}|!{2})[^\n]*?(?:[#*$%&|<>]{2}|!{2})[^\n]*?(?:[#*$%&|<>]{2}|!{2})"
# Navigation: words set between separators, as in menus, breadcrumbs and tag lists.
SEPARATED = r"\x20[|>»•·/]\x20[^\n]*?\x20[|>»•·/]\x20[^\n]*?\x20[|>»•·/]\x20"
# What a line must hold to be strewn or separated: one look at the text spares most lines both rules.
ODD = r"[#*$%&|<>!»•·/]"
# Boilerplate: wording that belongs to the page and not to its text.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "enable javascript",
    "subscribe to our", "sign up for", "read more", "share this", "powered by", "lorem ipsum", "skip to content",
    "skip to main content", "back to top",
)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, SPACE)).otherwise(
        F.array().cast("array<string>")
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more (all occurrences count).

    Windows are compared by a 64-bit digest of their words' 64-bit digests; ``width`` is a power of two."""

    def doubled(step: int):
        return lambda hashes: F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def windows(hashes: Column) -> Column:
        # Digests of 2, 4, ... words, each from two of half the width.
        out, step = hashes, 1
        while step < width:
            out, step = _let(out, doubled(step)), step * 2
        return F.slice(out, F.lit(1), F.size(hashes) - (width - 1))

    def covered(found: Column) -> Column:
        # Sorted by digest, an occurrence that is not the only one has an equal neighbour.
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def alike(row: Column, k: Column) -> Column:
                before, after = F.get(rows, k - 1)["h"] == row["h"], F.get(rows, k + 1)["h"] == row["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, alike), lambda row: row["i"]))

        def reach(at: Column) -> Column:
            steps = F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return _let(_let(ordered, starts), reach)

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(covered(found))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < width + 1, F.lit(0).cast("bigint")).otherwise(_let(_let(hashes, windows), count))


def _mentions(text: Column) -> Column:
    hits = [text.contains(phrase) for phrase in BOILERPLATE]
    return reduce(or_, hits)


def ends_well(line: Column) -> Column:
    """Whether a line is blank or ends like a sentence: with a sign, then closing marks, then blanks, any number of either."""
    bare = F.rtrim(line, F.lit(BLANKS))
    return (F.length(bare) == 0) | F.position(F.right(F.rtrim(bare, F.lit(CLOSERS)), F.lit(1)), F.lit(ENDS)).between(1, len(ENDS)) & (
        F.length(F.rtrim(bare, F.lit(CLOSERS))) > 0
    )


def line_passes(line: Column) -> Column:
    """Whether a line stays: no rule speaks against it. A line without words passes."""
    bad = line.rlike(STREWN) | line.rlike(SEPARATED) | _mentions(F.lower(line))
    return ends_well(line) & ~bad


def passing_lines(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    suspect = text.rlike(ODD) | _mentions(F.lower(text))
    return F.array_join(F.when(suspect, F.filter(lines, line_passes)).otherwise(F.filter(lines, ends_well)), "\n")


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) with the measures n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, and the verdict: clean_text (the lines that pass), n_lost (words
    in the lines removed) and kept.

    kept is false if base_failed (fewer than 20 words, or over 30 percent of them in repeated 8-word windows)
    or if over ``max_lost`` of the words lie in removed lines. Null text counts as empty: no words, not kept, clean_text
    null. Columns of those names in ``docs`` are replaced. Every row is judged alone: nothing is shuffled, and
    repeated rows give repeated results; an empty table gives none."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_lost", "kept"]
    df = docs.drop(*own)
    text, safe = F.col("text"), F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(safe, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_words", words(text)).withColumn("_lines", lines)
    df = df.select(
        *[c for c in df.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length(safe) - F.length(F.translate(safe, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        passing_lines(text).alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.coalesce(F.regexp_count("clean_text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    lost = F.when(F.length("clean_text") == F.length(text), F.lit(0)).otherwise(F.col("n_words") - left).cast("bigint")
    df = df.withColumn("base_failed", failed).withColumn("n_lost", lost)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") <= F.col("n_words") * F.lit(max_lost)))


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The kept documents with the columns of ``docs``: text without its failing lines, n_chars following."""
    judged = clean_lines(docs, **options).filter("kept")
    values = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("clean_text").cast("bigint")
    return judged.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


_SQL_WORD = r"[^\x20\x09-\x0D]+"
_SQL_END = r"""[.!?…。！？:;]["''”’»)\]*_]*[\x20\x09-\x0D]*$"""
_SQL_PASS = f"""(NOT regexp_matches(line, '{_SQL_WORD}') OR regexp_matches(line, '{_SQL_END}'))
      AND NOT regexp_matches(line, '{STREWN}') AND NOT regexp_matches(line, '{SEPARATED}')
      AND NOT regexp_matches(lower(line), '{'|'.join(BOILERPLATE)}')"""
#: Over a relation ``documents``; also the first stage of the pipeline.
RULES_CTE = rf"""
rule_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord
  FROM documents WHERE text IS NOT NULL),
rule_judged AS (SELECT *, regexp_matches(line, '{_SQL_WORD}') AS worded, {_SQL_PASS} AS passes FROM rule_lines),
rule_clean AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (passes), '') AS clean_text,
    (count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded))::BIGINT AS n_dup_lines FROM rule_judged GROUP BY doc_id),
rule_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS ws FROM documents),
rule_windows AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM rule_words WHERE len(ws) >= 8)),
rule_repeats AS (SELECT doc_id, i FROM rule_windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rule_spans AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM rule_repeats),
rule_counts AS (SELECT doc_id, sum(step)::BIGINT AS n_repeat_words FROM rule_spans GROUP BY doc_id),
rule_measured AS (SELECT d.*, len(w.ws)::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(c.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, c.clean_text,
    len(w.ws) - len(regexp_extract_all(coalesce(c.clean_text, ''), '{_SQL_WORD}')) AS n_lost
  FROM documents d JOIN rule_words w USING (doc_id) LEFT JOIN rule_clean c USING (doc_id) LEFT JOIN rule_counts r USING (doc_id)),
rule_verdicts AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_lost <= n_words * 0.5 AS kept FROM rule_measured)"""

RULES_SQL = f"""WITH {RULES_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM rule_verdicts"""


@query("op5_clean_lines", RULES_SQL)
def op5_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
