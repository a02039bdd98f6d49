"""ISBN, DOI, citation keys, hosts and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.markup import let, trim

YEAR = "(?i)^[0-9]{4}[a-z]?$"


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def isbn_digits(text: Column) -> Column:
    """Digits and X only."""
    return F.nullif(F.upper(F.regexp_replace(text, "[^0-9Xx]", "")), F.lit(""))


def valid_isbn(text: Column) -> Column:
    isbn = isbn_digits(text)
    return F.when(F.length(isbn).isin(10, 13), isbn)


def norm_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(doi), "^https://doi\\.org/", "")


def harvard_key(surname: Column, year: Column) -> Column:
    return F.concat_ws("|", F.lower(surname), F.lower(year))


def stated_year(params: Column) -> Column:
    """The year parameter if it is one, else a four-digit word of the date."""
    year = trim(params["year"])
    from_date = F.regexp_extract(F.coalesce(params["date"], F.lit("")), r"\b(\d{4})\b", 1)
    return F.when(year.rlike(YEAR), year).when(from_date != "", from_date)


def author_line(names: Column) -> Column:
    """One name; two or three joined with &; four cut to three and et al."""
    return let(names, _author_line)


def _author_line(names: Column) -> Column:
    count = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(count - 1, F.lit(0))), ", ")
    return (
        F.when(count == 1, F.get(names, F.lit(0)))
        .when((count >= 2) & (count <= 3), F.concat_ws(" & ", head, F.try_element_at(names, F.lit(-1))))
        .when(count > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" et al.")))
    )


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*+://(?:[^/?#@\s]*+@)?([^/?#:@\s]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without www., null for anything that is no URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def clean_query(url: Column) -> Column:
    """Absolute link without utm_ parameters."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    path = F.substring_index(full, "?", 1)
    parts = F.split(F.substr(full, F.length(path) + 2), "&(?:amp;)?")
    kept = F.array_join(F.filter(parts, lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.when(F.instr(full, "?") == 0, full).when(
        kept != "", F.concat_ws("?", path, kept)
    ).otherwise(path)


def entity_id(uri: Column) -> Column:
    """The entity id at the end of an entity URI, else null."""
    found = F.regexp_extract(trim(uri), r"(Q\d+)$", 1)
    return F.when(found != "", found)
