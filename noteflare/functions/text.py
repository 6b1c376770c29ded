"""Scalar text operators as native Column expressions (whole-stage codegen).

Every function maps Column -> Column; none runs Python per row.
Regex flavour: Java.  ``(?U)`` makes ``\\b \\w \\s`` Unicode-aware the way
Python's ``re`` treats ``str`` patterns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteflare.constants import MASK_PATTERNS

ColumnOrName = Column | str

# Removed before tags so their content disappears with them; one left open runs to the end.
_HTML_BLOCKS = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
    r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)",
    r"(?is)<template\b[^>]*>.*?(?:</template\s*>|\z)",
    r"<![^>]*>",
    # A quoted attribute value may hold '>'.
    r"""</?[A-Za-z][^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*'|)[^>=]*+)*+>""",
)
# What may be a character reference: a number, or up to 32 characters that could name one.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def entity_table() -> dict[str, str]:
    """HTML 4 names with ';' and the legacy names that need none, from the standard library."""
    table = {name + ";": html5[name + ";"] for name in name2codepoint} | {"apos;": "'"}
    return table | {name: char for name, char in html5.items() if not name.endswith(";")}


def _legacy_prefix(entities: Mapping[str, str]) -> str:
    """Pattern of the longest name that needs no ';' at the start of a reference that runs on (``&notit`` is ``&not`` + ``it``)."""
    names = sorted((re.escape(n) for n in entities if not n.endswith(";")), key=len, reverse=True)
    return "^&(" + "|".join(names) + ")" if names else r"^(\b\B)"


_WS = r"[\s\x{00a0}]+"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(table: Mapping[str, str]) -> Column:
    """A constant map; Catalyst folds it once."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def decode_reference(ref: Column, entities: Mapping[str, str], more: Mapping[str, str] = html5) -> Column:
    """The text a reference such as ``&deg;``, ``&#176;`` or ``&#xb0;`` stands for, as the standard library's ``html.unescape``.

    A name is looked up whole, in ``entities`` and then in ``more`` (all HTML 5 names); if neither has it, the longest
    name of ``entities`` that needs no ';' is decoded and the rest stays.  Unknown names stay as they are.  Numbers: 128-159
    are read as Windows-1252, as browsers do; those that are no character give U+FFFD, control characters
    and non-characters nothing.
    """
    body = F.rtrim(ref, F.lit(";"))
    hexa = F.lower(F.substring(body, 1, 3)) == "&#x"
    digits = F.regexp_replace(F.when(hexa, F.substr(body, F.lit(4))).otherwise(F.substr(body, F.lit(3))), "^0+", "")
    code = (F.when(F.length(digits) > 8, F.lit(0x110000)).when(digits == "", F.lit(0))
            .when(hexa, F.conv(digits, 16, 10).try_cast("int")).otherwise(digits.try_cast("int")))
    code = F.coalesce(code, F.lit(0x110000))
    odd = {str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
    no_text = lambda n: (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
                         | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    # The lambda names the number, which is needed many times.
    char = F.transform(F.array(code), lambda n: (
        F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(n.between(128, 159), F.try_element_at(_literal_map(odd), n.cast("string")))
        .when(no_text(n), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))))[0]
    name = F.substr(ref, F.lit(2))
    prefix = F.regexp_extract(ref, _legacy_prefix(entities), 1)
    run_on = F.concat(F.try_element_at(_literal_map(entities), prefix), F.substr(name, F.length(prefix) + 1))
    known = [F.try_element_at(_literal_map(t), name) for t in (entities, more) if t]
    named = F.coalesce(*known, F.when(prefix != "", run_on), ref)
    return F.when(ref.startswith("&#"), char).otherwise(named)


def decode_references(text: Column, entities: Mapping[str, str], more: Mapping[str, str] = html5) -> Column:
    """Every character reference decoded in one pass, so ``&amp;lt;`` gives ``&lt;``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), 0), lambda r: decode_reference(r, entities, more))
    pieces = F.zip_with(F.split(text, _REFERENCE, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def clean_html(c: ColumnOrName, entities: Mapping[str, str] | None = None) -> Column:
    """Strip tags (each replaced by a space), decode character references, collapse whitespace, trim.

    NULL becomes "".  Names come from ``entities`` only, or by default from :func:`entity_table` and then all of HTML 5;
    others stay as is.  A '<' that does not open a tag (``BSA < 5%``) is kept.
    References are looked for only in text that contains '&'.
    """
    table, more = (entity_table(), html5) if entities is None else (entities, {})
    out = F.coalesce(_col(c).cast("string"), F.lit(""))
    for pattern in _HTML_BLOCKS:
        out = F.regexp_replace(out, pattern, " ")
    # The lambda names the stripped text, which is needed more than once.
    out = F.transform(F.array(out), lambda t: decode_references(t, table, more))[0]
    return F.trim(F.regexp_replace(out, _WS, " "))


def mask_terms(c: ColumnOrName) -> Column:
    """Mask post-flare / treatment terms that would leak the label.

    Three case-insensitive masks applied in order, then whitespace collapse.
    """
    out = F.coalesce(_col(c), F.lit(""))
    for pattern in MASK_PATTERNS:
        out = F.regexp_replace(out, "(?iU)" + pattern, " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def flag_any(c: ColumnOrName, terms: Iterable[str]) -> Column:
    """1 when the lower-cased text contains any term (plain substring), else 0."""
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    hit = None
    for t in terms:
        cond = low.contains(F.lit(t))
        hit = cond if hit is None else (hit | cond)
    return F.when(hit, 1).otherwise(0) if hit is not None else F.lit(0)


def matches(c: ColumnOrName, pattern: str) -> Column:
    """Case-insensitive regex search; NULL text is False."""
    return F.coalesce(_col(c), F.lit("")).rlike("(?iu)" + pattern)


def extract_first(c: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` (group ``group``) or NULL."""
    return F.nullif(F.regexp_extract(F.coalesce(_col(c), F.lit("")), pattern, group), F.lit(""))


def find_all(c: ColumnOrName, pattern: str) -> Column:
    """Every match of ``pattern`` as array<string>."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), 0)


def lower(c: ColumnOrName) -> Column:
    """X7."""
    return F.lower(_col(c))


def join_fields(*cols: ColumnOrName, sep: str = " ") -> Column:
    """``a + " " + b + ...`` of null-filled fields (empty fields keep their separator)."""
    return F.concat_ws(sep, *[F.coalesce(_col(c), F.lit("")) for c in cols])


def person_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``first || ' ' || last``; NULL when either part is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def parse_timestamp(c: ColumnOrName) -> Column:
    """Timestamp parse that yields NULL on bad input (never raises under ANSI)."""
    return F.try_to_timestamp(_col(c).cast("string"))


def parse_number(c: ColumnOrName, default: float | None = 0.0) -> Column:
    """X11: numeric parse with coercion; unparsable -> ``default``."""
    out = _col(c).try_cast("double")
    return F.coalesce(out, F.lit(default)) if default is not None else out


def round_to(c: ColumnOrName, digits: int) -> Column:
    """Half-up rounding to ``digits`` places."""
    return F.round(_col(c), digits)


def month_start(c: ColumnOrName) -> Column:
    """Truncate a timestamp to the first day of its month."""
    return F.date_trunc("month", _col(c))
