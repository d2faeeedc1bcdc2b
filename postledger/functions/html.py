"""HTML text handling as column expressions (no Python workers)."""
from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_lines

# --- fixed values: what counts as a reference, a tag and hidden markup ---------
_TOKEN = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_TAG = r"<[^>]+>"
_HIDDEN = r"(?isu)<(script|style|noscript|svg)[^>]*>.*?</\1>"
_COMMENT = r"(?s)<!--.*?-->"
# -------------------------------------------------------------------------------

_REPLACEMENT = "\ufffd"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``. Inside a lambda
    repeated expressions are not shared by the code generator."""
    return F.transform(F.array(value), body)[0]


def _constant_map(values: dict[str, str]) -> Column:
    # from_json over a literal is folded once per query, so the plan stays small
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _by_first_letter(values: dict[str, str], key: Column) -> Column:
    """Look up a large constant map in two short steps (map look-ups are linear)."""
    groups: dict[str, dict[str, str]] = {}
    for name, text in values.items():
        groups.setdefault(name[0], {})[name] = text
    table = F.from_json(F.lit(json.dumps(groups)), "map<string,map<string,string>>")
    return F.element_at(F.element_at(table, F.substring(key, 1, 1)), key)


def _numeric(token: Column) -> Column:
    """Character for a ``#123;`` or ``#x1F;`` token."""
    digits = F.regexp_replace(token, r"^#[xX]?0*|;$", "")
    is_hex = token.rlike("^#[xX]")
    # eight digits or more are past the last code point in both bases
    value = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
        F.coalesce(
            F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int"), F.lit(0)
        )
    )
    # Controls and the C1 block follow special rules; the table is derived.
    low = _constant_map({str(n): html.unescape(f"&#{n};") for n in range(160)})

    def character(n: Column) -> Column:
        non_character = n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE
        return (
            F.when(n < 160, F.element_at(low, n.cast("string")))
            .when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(_REPLACEMENT))
            .when(non_character | n.between(0xFDD0, 0xFDEF), F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return _let(value, character)


def _named(token: Column) -> Column:
    """Text for a named token; the longest legacy prefix counts without ``;``."""
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    prefix = F.regexp_extract(token, "^(?:" + "|".join(legacy) + ")", 0)
    by_prefix = F.concat(
        F.element_at(_constant_map({n: html5[n] for n in legacy}), prefix),
        F.substring(token, F.length(prefix) + 1, F.length(token)),
    )
    common = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "rsquo;", "ndash;", "mdash;")
    chain = F.when(token == common[0], F.lit(html5[common[0]]))
    for name in common[1:]:
        chain = chain.when(token == name, F.lit(html5[name]))
    return chain.otherwise(F.coalesce(_by_first_letter(dict(html5), token), by_prefix))


def html_unescape(c: Column) -> Column:
    """Decode every character reference of HTML 5.

    Text without ``&`` passes through untouched. Otherwise the text is cut at
    each ``&``; every piece starts with its own reference.
    """

    def decode(part: Column, token: Column) -> Column:
        rest = F.substring(part, F.length(token) + 1, F.length(part))
        decoded = F.when(token.startswith("#"), _numeric(token)).when(token != "", _named(token))
        return F.coalesce(F.concat(decoded, rest), F.concat(F.lit("&"), part))

    def piece(part: Column) -> Column:
        return _let(F.regexp_extract(part, _TOKEN, 0), lambda token: decode(part, token))

    def whole(text: Column) -> Column:
        def joined(pieces: Column) -> Column:
            tail = F.transform(F.slice(pieces, 2, F.size(pieces)), piece)
            return F.concat(pieces[0], F.array_join(tail, ""))

        return F.when(text.contains("&"), _let(F.split(text, "&", -1), joined)).otherwise(text)

    return _let(c, whole)


def clean_html(c: Column) -> Column:
    """Description markup to text: references are decoded before tags go."""
    return strip_lines(F.regexp_replace(html_unescape(c), _TAG, "\n"))


def extract_text(c: Column) -> Column:
    """Visible text of a page: hidden markup goes first, references are decoded last."""
    visible = F.regexp_replace(F.regexp_replace(c, _HIDDEN, " "), _COMMENT, " ")
    return strip_lines(html_unescape(F.regexp_replace(visible, _TAG, "\n")))
