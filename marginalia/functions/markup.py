"""HTML and wiki markup as column expressions.

Nesting is read to any depth by a fold over the marks of a text. Runs up to a
closing tag are looked for only before the last such tag, where each finds its
end; no pattern crosses more than one tag elsewhere. So a hostile page costs
linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Double braces and brackets become single control characters, so that one
# character class can tell "inside" from "outside". Such characters in the
# text itself are dropped first.
OPEN_T, CLOSE_T, OPEN_L, CLOSE_L = "\u0001", "\u0002", "\u0003", "\u0004"
OPEN_R, CLOSE_R = "\u0005", "\u0006"  # begin and end of a run to be cut
MARKS = OPEN_T + CLOSE_T + OPEN_L + CLOSE_L + OPEN_R + CLOSE_R
_REF = r"(?is)<ref\b[^<>]*+(?<!/)>(.*?)</ref>"


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text, F.lit(" \t\n\r\u00a0"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{MARKS}]+", "")


def mark_nesting(text: Column) -> Column:
    text = without_marks(text)
    for plain, mark in (("{{", OPEN_T), ("}}", CLOSE_T), ("[[", OPEN_L), ("]]", CLOSE_L)):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unmark_nesting(text: Column) -> Column:
    for plain, mark in (("{{", OPEN_T), ("}}", CLOSE_T), ("[[", OPEN_L), ("]]", CLOSE_L)):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def up_to_last(text: Column, closing: str) -> Column:
    """The text through the last match of ``closing``; empty without one. The
    greedy run goes to the end at once and comes back from there."""
    return F.coalesce(F.regexp_extract(text, f"(?s)^.*(?:{closing})", 0), F.lit(""))


def cut_runs(text: Column, opening: str, closing: str, by: str = " ") -> Column:
    """Every run from a match of ``opening`` to the next ``closing`` becomes
    ``by``. What opens behind the last closing runs nowhere and stays."""

    def marked(held: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(held, f"({opening})", f"{OPEN_R}$1"), f"({closing})", f"$1{CLOSE_R}")

    def cut(t: Column) -> Column:
        tail = F.substring_index(t, CLOSE_R, -1)
        head = F.left(t, F.length(t) - F.length(tail))
        done = F.regexp_replace(head, f"{OPEN_R}[^{CLOSE_R}]*+{CLOSE_R}", by)
        return F.regexp_replace(F.concat(done, tail), f"[{OPEN_R}{CLOSE_R}]+", "")

    return let(text, lambda held: F.when(held.rlike(opening), let(marked(held), cut)).otherwise(held))


def _pieces(marked: Column, marks: str) -> Column:
    """The text cut before every mark."""
    return F.split(marked, f"(?=[{marks}])", -1)


def first_balanced(marked: Column, opening: str, closing: str) -> Column:
    """From the first opening mark to the closing one that balances it, at
    any depth; null where there is none or it stays open."""

    def find(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

        def step(s: Column, piece: Column) -> Column:
            depth = s["depth"] + F.when(piece.startswith(opening), 1).when(piece.startswith(closing), -1).otherwise(0)
            ends = (s["end"] == 0) & (depth == 0)
            return F.struct(
                (s["i"] + 1).alias("i"), F.when(s["end"] > 0, 0).otherwise(depth).alias("depth"),
                F.when(ends, s["i"]).otherwise(s["end"]).alias("end"),
            )

        end = F.aggregate(pieces, zero, step, lambda s: s["end"])
        return let(
            end, lambda e: F.when(e > 0, F.concat(F.array_join(F.slice(pieces, F.lit(1), e), ""), F.lit(closing)))
        )

    def begun(held: Column) -> Column:
        start = F.instr(held, opening)
        return F.when(start > 0, let(_pieces(F.substr(held, start), opening + closing), find))

    # Most runs hold no other one; a single match finds these.
    flat = f"^[^{opening}]*+({opening}[^{opening}{closing}]*+{closing})"
    return let(
        marked, lambda held: let(F.regexp_extract(held, flat, 1), lambda run: F.when(run != "", run).otherwise(begun(held)))
    )


def all_balanced(marked: Column, opening: str, closing: str, starts: str) -> Column:
    """Every balanced run, at any depth and inside others too, whose opening
    mark is followed by a match of ``starts``, in the order they begin."""

    def find(pieces: Column) -> Column:
        pair = "array<struct<a:int,b:int>>"
        zero = F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("depth"), F.array().cast(pair).alias("open"), F.array().cast(pair).alias("runs")
        )

        def step(s: Column, piece: Column) -> Column:
            opens, closes = piece.startswith(opening), piece.startswith(closing)
            depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            last = F.try_element_at(s["open"], F.lit(-1))
            ends = closes & F.coalesce(last["b"] == depth, F.lit(False))
            return F.struct(
                (s["i"] + 1).alias("i"), depth.alias("depth"),
                F.when(piece.rlike(f"^{opening}{starts}"), F.array_append(s["open"], F.struct(s["i"].alias("a"), s["depth"].alias("b"))))
                .when(ends, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
                F.when(ends, F.array_append(s["runs"], F.struct(last["a"].alias("a"), s["i"].alias("b"))))
                .otherwise(s["runs"]).alias("runs"),
            )

        runs = F.sort_array(F.aggregate(pieces, zero, step, lambda s: s["runs"]))
        return F.transform(
            runs, lambda r: F.concat(F.array_join(F.slice(pieces, r["a"] + 1, r["b"] - r["a"]), ""), F.lit(closing))
        )

    none = F.array().cast("array<string>")
    return let(
        marked, lambda held: F.when(held.rlike(f"{opening}{starts}"), let(_pieces(held, opening + closing), find)).otherwise(none)
    )


def cut_balanced(marked: Column, opening: str, closing: str, starts: str = "") -> Column:
    """Without the outermost balanced runs whose opening mark is followed by
    a match of ``starts``; one that stays open is kept."""

    def cut(pieces: Column) -> Column:
        span = "array<struct<a:int,b:int>>"
        zero = F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("base"), F.lit(-1).alias("from"),
            F.array().cast(span).alias("runs"),
        )

        def step(s: Column, piece: Column) -> Column:
            opens, closes = piece.startswith(opening), piece.startswith(closing)
            begins = opens & (s["from"] < 0) & (piece.rlike(f"^{opening}{starts}") if starts else F.lit(True))
            depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            ends = closes & (s["from"] >= 0) & (depth == s["base"])
            return F.struct(
                (s["i"] + 1).alias("i"), depth.alias("depth"),
                F.when(begins, s["depth"]).otherwise(s["base"]).alias("base"),
                F.when(begins, s["i"]).when(ends, -1).otherwise(s["from"]).alias("from"),
                F.when(ends, F.array_append(s["runs"], F.struct(s["from"].alias("a"), s["i"].alias("b"))))
                .otherwise(s["runs"]).alias("runs"),
            )

        def rest(runs: Column) -> Column:
            # The piece that closes a run keeps what stands behind its mark.
            bare = F.transform(
                pieces, lambda p, i: F.when(F.exists(runs, lambda r: r["b"] == i), F.substr(p, F.lit(2))).otherwise(p)
            )
            kept = F.filter(bare, lambda p, i: ~F.exists(runs, lambda r: (r["a"] <= i) & (i < r["b"])))
            return F.when(F.size(runs) > 0, F.array_join(kept, "")).otherwise(F.array_join(pieces, ""))

        return let(F.aggregate(pieces, zero, step, lambda s: s["runs"]), rest)

    return let(
        marked, lambda held: F.when(F.instr(held, opening) > 0, let(_pieces(held, opening + closing), cut)).otherwise(held)
    )


def ref_templates(wikitext: Column) -> Column:
    """Refs that have a body, in order: struct(ord, body, template). Body and
    template are still marked; the template is the one at the first opening
    braces, or empty if these stay open. One pass over the text, however the
    result is filtered later."""
    text = up_to_last(mark_nesting(F.coalesce(wikitext, F.lit(""))), r"(?i)</ref>")
    bodies = F.regexp_extract_all(text, F.lit(_REF), F.lit(1))
    return F.transform(
        bodies,
        lambda body, i: F.struct(
            (i + 1).cast("bigint").alias("ord"), body.alias("body"),
            F.coalesce(first_balanced(body, OPEN_T, CLOSE_T), F.lit("")).alias("template"),
        ),
    )


def template_parts(template: Column) -> Column:
    """Top-level pieces between the pipes; the first is the template's name.
    Braces and brackets count alike, and what closes too often counts as
    nothing."""
    body = F.regexp_replace(template, f"^\\s*{OPEN_T}|{CLOSE_T}\\s*$", "")

    def parts(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("at"))

        def step(s: Column, piece: Column) -> Column:
            mark = F.substring(piece, 1, 1)
            depth = s["depth"] + F.when(mark.isin(OPEN_T, OPEN_L), 1).when(mark.isin(CLOSE_T, CLOSE_L), -1).otherwise(0)
            parts_here = (mark == "|") & (s["depth"] == 0)
            return F.struct(
                (s["i"] + 1).alias("i"), F.greatest(depth, F.lit(0)).alias("depth"),
                F.when(parts_here, F.array_append(s["at"], s["i"])).otherwise(s["at"]).alias("at"),
            )

        def joined(at: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                end = F.coalesce(F.get(at, k + 1), F.size(pieces))
                text = F.array_join(F.slice(pieces, a + 1, end - a), "")
                return F.when(k > 0, F.substr(text, F.lit(2))).otherwise(text)

            return F.transform(at, one)

        starts = F.aggregate(pieces, zero, step, lambda s: F.array_distinct(s["at"]))
        # A body that begins with a pipe has an empty name in front of it.
        return let(starts, joined)

    def split(lead: Column) -> Column:
        nested = let(_pieces(lead, MARKS[:4] + "|"), parts)
        return F.when(lead.rlike(f"[{MARKS[:4]}]"), nested).otherwise(F.split(lead, "\\|", -1))

    return let(let(body, lambda b: F.when(b.startswith("|"), F.concat(F.lit(" "), b)).otherwise(b)), split)


def template_params(template: Column) -> Column:
    """Named parameters as a map with lower-case keys; the last of equal keys
    stays."""
    named = F.filter(template_parts(template), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(
        named,
        lambda p: F.struct(
            F.lower(trim(F.substring_index(p, "=", 1))).alias("key"),
            trim(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
        ),
    )

    def last_of_each(found: Column) -> Column:
        last = F.filter(
            found,
            lambda p, i: ~F.exists(
                F.slice(found, i + 2, F.size(found)), lambda later: later["key"] == p["key"]
            ),
        )
        return F.when(F.size(F.array_distinct(F.transform(found, lambda p: p["key"]))) < F.size(found), last).otherwise(found)

    return F.map_from_entries(let(pairs, last_of_each))


def strip_tags(text: Column) -> Column:
    """Comments go first (an unclosed one runs to the end), then tags."""
    without = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")
    return F.regexp_replace(without, r"<[^<>]++>", "")


def strip_markup(text: Column) -> Column:
    """Links to their labels, bold and tags removed; empty becomes null. Most
    values hold no markup, and one look tells."""

    def strip(held: Column) -> Column:
        marked = held.rlike(f"[{OPEN_T}-{CLOSE_L}<\\[']|\\s\\s|[\\t\\n\\r]")
        plain = unmark_nesting(held)
        plain = F.regexp_replace(plain, r"\[\[[^\]|]*+\|([^\]]*+)\]\]", "$1")
        plain = F.regexp_replace(plain, r"\[\[([^\]]*+)\]\]", "$1")
        plain = F.regexp_replace(plain, "'''?", "")
        plain = trim(F.regexp_replace(strip_tags(plain), r"\s+", " "))
        return F.when(marked, plain).otherwise(trim(held))

    return let(let(text, strip), lambda t: F.when(t != "", t))


def _decode_numeric(text: Column, pattern: str, base: int) -> Column:
    def put(acc: Column, code: Column) -> Column:
        digits = F.conv(code, base, 16)
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        head = "&#" if base == 10 else "&#x"
        return F.replace(acc, F.concat(F.lit(head), code, F.lit(";")), char)

    def codes(of: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(of, F.lit(pattern), F.lit(1)))

    return let(text, lambda t: F.when(t.contains("&#"), F.aggregate(codes(t), t, put)).otherwise(t))


def decode_entities(text: Column) -> Column:
    """Numeric entities, then the common named ones; leftover [n] markers go."""
    text = _decode_numeric(text, r"&#(\d{1,7});", 10)
    text = _decode_numeric(text, r"&#[xX]([0-9a-fA-F]{1,6});", 16)
    for entity, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"\[\d+\]", "")


def one_line(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def html_text(html: Column) -> Column:
    return one_line(decode_entities(strip_tags(html)))
