"""Text normalisation as column expressions.

White space means the Unicode set that Python strings use, spelled out so that
regular expressions need no Unicode mode.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# --- fixed values: endings that do not distinguish two titles or places --------
_TITLE_PARENTHESIS = rf"(?d){WS}*\(.*?\){WS}*$"
_TITLE_MARKER = rf"(?idu){WS}*-{WS}*(?:urgent|new|posted).*?$"
_PLACE_COUNTRY = rf"(?idu){WS}*,{WS}*USA?{WS}*$"
_PLACE_PARENTHESIS = rf"{WS}*\([^)]*\)"
TRUNCATION_MARK = " [truncated]"
# -------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WS_CHARS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", " ")


def strip_lines(c: Column) -> Column:
    """Strip every line and drop the empty ones (measured several times faster
    than one regular expression over the whole text)."""
    lines = F.transform(F.split(c, "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string.

    Of the last value that is what it is itself, unless null, so it stands (and is evaluated) once."""
    return F.coalesce(*[blank_to_null(c) for c in cols[:-1]], cols[-1], F.lit(""))


def normalize_title(c: Column) -> Column:
    base = strip(F.lower(c))
    no_note = F.regexp_replace(base, _TITLE_PARENTHESIS, "")
    return collapse(F.regexp_replace(no_note, _TITLE_MARKER, ""))


def normalize_location(c: Column) -> Column:
    base = strip(F.lower(c))
    no_country = F.regexp_replace(base, _PLACE_COUNTRY, "")
    return strip(collapse(F.regexp_replace(no_country, _PLACE_PARENTHESIS, "")))


def normalize_company(c: Column) -> Column:
    return collapse(strip(F.lower(c)))


def truncate_text(c: Column, n: int = 2000) -> Column:
    """At most ``n`` characters, cut after a sentence if one ends in the last fifth."""
    head = F.substring(c, 1, n)
    from_end = F.locate(".", F.reverse(head))
    last_dot = F.lit(n) - from_end  # zero-based; equals n when there is no dot
    return (
        F.when(F.length(c) <= n, c)
        .when((from_end > 0) & (last_dot > F.lit(n * 0.8)), F.substring(head, F.lit(1), last_dot + 1))
        .otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))
    )


def _joined(*cols: Column) -> Column:
    # concat_ws would skip nulls and so let two different rows agree
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("|"), F.coalesce(c, F.lit(""))]
    return F.concat(*parts[1:])


def content_hash(company: Column, title: Column, location: Column, description: Column,
                 apply_url: Column) -> Column:
    """Identity of the published content; the values are hashed as they are."""
    return F.sha2(_joined(company, title, location, description, apply_url), 256)


def fingerprint(company: Column, title: Column, location: Column, apply_url: Column) -> Column:
    """Identity of a posting across sources, from normalised values."""
    return F.md5(
        _joined(normalize_company(company), normalize_title(title),
                normalize_location(location), apply_url)
    )


def flatten_scalar(c: Column) -> Column:
    """One-line form of a field value."""
    return strip(collapse(F.coalesce(c.cast("string"), F.lit(""))))


def escape_terminator(c: Column, terminator: str) -> Column:
    """Rewrite lines equal to a record terminator so they cannot end the record."""
    line = rf"(?mid)^{WS}*{terminator}{WS}*$"
    return F.regexp_replace(c, line, terminator.replace(" ", "_"))


def cap_description(c: Column, n: int) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(TRUNCATION_MARK))).otherwise(text)


def source_id(company_id: Column, source_type: Column) -> Column:
    return F.concat(company_id, F.lit("#"), source_type)


def internal_id(source: Column, job_id: Column) -> Column:
    return F.concat(source, F.lit("#"), job_id)


def uuid5_url(url: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a text."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    digest = F.sha1(F.concat(namespace, F.encode(url, "UTF-8")))
    variant = F.lower(
        F.lpad(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)) + 128), 2, "0")
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )
