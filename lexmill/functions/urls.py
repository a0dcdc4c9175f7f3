"""Parts, resolution and filters of URLs, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PORT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def port(url: Column) -> Column:
    """The explicit port, empty if there is none."""
    return F.regexp_extract(url, PORT, 1)


def query_item(url: Column, name: str) -> Column:
    """The value of a query parameter, null if it is absent."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def without_dots(path: Column) -> Column:
    """A path whose segments . and .. are carried out; one that ends in them ends in a slash."""
    parts = F.split(path, "/", -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.array_join(walked, "/"), F.when(ends, "/").otherwise(""))).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute, scheme-relative, rooted, relative to the page's path, a query, a fragment or empty."""
    origin, page = F.regexp_extract(base, ORIGIN, 1), F.regexp_extract(base, PATH, 1)
    path, rest = F.regexp_extract(link, "^[^?#]*", 0), F.regexp_extract(link, "(?s)^[^?#]*(.*)$", 1)
    folder = F.when(page == "", "/").otherwise(F.regexp_extract(page, "^(?:.*/)?", 0))
    return (
        F.when(link.rlike(SCHEME), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), link))
        .when(link.startswith("/"), F.concat(origin, without_dots(path), rest))
        .when(link.startswith("?"), F.concat(origin, page, link))
        .when((link == "") | link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(origin != "", F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


def allowed_scheme(url: Column, schemes: Sequence[str] = ("http", "https")) -> Column:
    return scheme(url).isin(*schemes)


def in_domain(base_host: Column | str, resolved: Column) -> Column:
    """Whether the host is that of the base, which may not be empty."""
    if isinstance(base_host, str):
        if not base_host:
            raise ValueError("the base URL has no host")
        base_host = F.lit(base_host)
    return host(resolved) == base_host


def allowed_port(url: Column, ports: Sequence[int]) -> Column:
    """Whether an explicit port is listed; a URL without one passes."""
    return (port(url) == "") | port(url).isin(*[str(p) for p in ports])


def without_words(url: Column, words: Sequence[str]) -> Column:
    """Whether no word occurs in the URL, a first hit on its last character not counting."""
    passes = F.lit(True)
    for w in words:
        at = F.instr(url, w)
        passes = passes & ((at == 0) | (at == F.length(url)))
    return passes


def is_textual(body: Column) -> Column:
    """Whether the first 1024 characters look like text: no NUL and few control characters."""
    head = F.substring(body, 1, 1024)
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0E-\x1F\x7F]", ""))
    return ~head.contains("\x00") & (control * 10 <= F.length(head)) & (F.length(head) > 0)


def accepts_text(content_type: Column, body: Column) -> Column:
    """By the declared type where there is one, else by the body."""
    return F.when(content_type.isNotNull(), content_type.startswith("text/")).otherwise(is_textual(body))
