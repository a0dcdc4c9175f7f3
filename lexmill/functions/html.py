"""Text nodes and links of HTML pages, as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN, join_trailing, sorted_set

COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
TAG = r"""(?s)<[a-zA-Z!/](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z!/][^>]*>"""
#: The value of an anchor's href with its quotes, if it has any; other attributes may hold anything in quotes.
HREF = r"""(?is)<a(?=[\s/])(?:[^<>"'h]++|"[^"]*+"|'[^']*+'|h)*?(?<=[\s"'/])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]++)"""
SPACE = r"\s+"
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_CUT = "\x01"


def _named() -> Column:
    """The named references by first letter: a map of maps, which Spark folds into a constant."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        if name.endswith(";"):
            by_letter.setdefault(name[0], {})[name[:-1]] = chars
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def unescape(text: Column) -> Column:
    """Character references decoded, once: decimal, hexadecimal and named ones that end in a semicolon; unknown ones stay."""
    named = _named()

    def one(part: Column) -> Column:
        found = part.rlike("^" + _REFERENCE)
        ref = F.substring_index(F.substring(part, 2, 40), ";", 1)
        hexadecimal = F.lower(F.substring(ref, 2, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(ref.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")).otherwise(named[F.substring(ref, 1, 1)][ref])
        return F.when(found & char.isNotNull(), F.concat(char, F.substring(part, F.length(ref) + 3, F.length(part)))).otherwise(part)

    return F.when(text.contains("&") & text.contains(";"), F.array_join(F.transform(F.split(text, f"(?={_REFERENCE})"), one), "")).otherwise(text)


def bare(html: Column) -> Column:
    """A page without comments, scripts and styles."""
    for pattern in (COMMENT, SCRIPT, STYLE):
        html = F.regexp_replace(html, pattern, " ")
    return html


def text_nodes(html: Column) -> Column:
    """Non-blank text nodes in page order, without comments, scripts and styles; white space collapsed."""
    parts = F.split(F.regexp_replace(bare(html), TAG, _CUT), _CUT)
    clean = F.transform(parts, lambda t: F.trim(F.regexp_replace(F.translate(unescape(t), "\u00a0", " "), SPACE, " ")))
    return F.filter(clean, lambda t: t != "")


def links(html: Column) -> Column:
    """The href of every anchor that has one, in page order, repeats included; quoted either way or not at all, references decoded."""
    raw = F.regexp_extract_all(bare(html), F.lit(HREF), F.lit(1))
    return F.transform(raw, lambda v: F.trim(unescape(F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))))


def link_set(html: Column) -> Column:
    """The distinct links, sorted."""
    return sorted_set(links(html))


def word_tokens(html: Column) -> Column:
    """The words of all text nodes, in order, repeats included."""
    return F.flatten(F.transform(text_nodes(html), lambda t: F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))))


def plain_text(html: Column, separator: str = " ") -> Column:
    """All text nodes, each followed by the separator."""
    return join_trailing(text_nodes(html), separator)
