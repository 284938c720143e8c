"""URL normalisers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import SPACE, let, strip_space, text_or_blank

ORIGIN = r"^(?i)(https?)://([^/?#\\]*)"


def _escape_path(c: Column) -> Column:
    """Percent-encode what a URL path or query may not hold as it is."""
    unsafe = r"[^\x21-\x7e]|[\"<>`{}]"
    encoded = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda x: F.when(
                x.rlike(unsafe), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")
            ).otherwise(x),
        ),
        "",
    )
    return F.when(c.rlike(unsafe), encoded).otherwise(c)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    start = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.array_append(acc, seg))
        )

    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, start, step), "/"))
    # A path that ends in a dot segment names a folder.
    folded = F.when(path.rlike(r"/\.{1,2}$") & ~folded.endswith("/"), F.concat(folded, F.lit("/"))).otherwise(folded)
    # Most paths have no segment that starts with a dot.
    return F.when((path.contains("/.") | path.startswith(".")) & path.rlike(r"(^|/)\.{1,2}(/|$)"), folded).otherwise(path)


def _host(c: Column) -> Column:
    """Lower-case host with the default port removed, user part kept out."""
    authority = F.lower(F.regexp_extract(c, ORIGIN, 0))
    bare = F.regexp_replace(authority, "^(https?://)[^@]*@", "$1")
    bare = F.regexp_replace(bare, "^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.regexp_replace(bare, "^https?://", "")


def origin_of(c: Column) -> Column:
    """``scheme://host[:port]``, blank when the text is not an http(s) URL."""
    return let(
        F.struct(F.lower(F.regexp_extract(c, ORIGIN, 1)).alias("scheme"), _host(c).alias("host")),
        lambda p: F.when(
            p["host"].rlike(r"^[^\s:]+(:[0-9]{1,5})?$"), F.concat(p["scheme"], F.lit("://"), p["host"])
        ).otherwise(""),
    )


def base_url(c: Column) -> Column:
    """Add ``https://`` where no scheme is given and reduce to the origin."""

    def reduce_to_origin(raw: Column) -> Column:
        full = F.when(raw.rlike(r"(?i)^https?://"), raw).otherwise(
            F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", ""))
        )
        return let(
            full,
            lambda f: F.when(raw == "", "").otherwise(
                F.coalesce(F.nullif(origin_of(f), F.lit("")), F.regexp_replace(f, "/+$", ""))
            ),
        )

    return let(strip_space(text_or_blank(c)), reduce_to_origin)


def _path(b: Column) -> Column:
    return let(F.regexp_extract(b, r"(?i)^https?://[^/?#\\]*([^?#]*)", 1), lambda p: F.when(p == "", "/").otherwise(p))


def _query(b: Column) -> Column:
    return F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)


def _origin(b: Column) -> Column:
    """The same as ``origin_of``, with one test for a plain host that a path follows."""
    return F.when(b.rlike(PLAIN_BASE), F.substring_index(b, "/", 3)).otherwise(origin_of(b))


def _resolve(b: Column, s: Column) -> Column:
    """A relative link on a page address. What a branch does not need is not computed."""
    return let(_origin(b), lambda origin: F.when(s.rlike(UNPLAIN), _resolve_any(b, s, origin)).otherwise(_resolve_plain(b, s, origin)))


def _resolve_plain(b: Column, s: Column, origin: Column) -> Column:
    """A link of printable ASCII characters none of which needs escaping."""
    link = F.substring_index(F.substring_index(s, "?", 1), "#", 1)

    def join(link: Column) -> Column:
        folder = F.regexp_extract(_path(b), r"^(.*/)", 1)
        path = F.when(link.startswith("/"), let(link, _fold_dots)).otherwise(let(let(F.concat(folder, link), _fold_dots), _escape_path))
        return F.concat(origin, path, F.substring(s, F.length(link) + 1, F.length(s)))

    return (
        F.when(origin == "", s)
        .when(s.startswith("//"), F.concat(F.lower(F.regexp_extract(b, ORIGIN, 1)), F.lit(":"), s))
        .when(s.startswith("?"), F.concat(origin, _path(b), s))
        .when(s.startswith("#"), F.concat(origin, _path(b), _query(b), s))
        .otherwise(let(link, join))
    )


def _resolve_any(b: Column, s: Column, origin: Column) -> Column:
    clean = F.translate(s, "\t\n\r", "")
    parts = F.struct(
        clean.alias("s"),
        origin.alias("origin"),
        _path(b).alias("path"),
        _query(b).alias("query"),
        F.regexp_extract(clean, r"^([^?#]*)", 1).alias("link"),
        F.regexp_extract(clean, r"^[^?#]*(.*)$", 1).alias("tail"),
    )

    def join(p: Column) -> Column:
        target = F.when(p["link"].startswith("/"), p["link"]).otherwise(
            F.concat(F.regexp_extract(p["path"], r"^(.*/)", 1), p["link"])
        )
        return (
            F.when(p["origin"] == "", s)
            .when(s.startswith("//"), F.concat(F.lower(F.regexp_extract(b, ORIGIN, 1)), F.lit(":"), s))
            .when(s.startswith("?"), F.concat(p["origin"], p["path"], let(p["s"], _escape_path)))
            .when(s.startswith("#"), F.concat(p["origin"], p["path"], p["query"], let(p["s"], _escape_path)))
            .otherwise(
                F.concat(p["origin"], let(let(target, _fold_dots), _escape_path), let(p["tail"], _escape_path))
            )
        )

    return let(parts, join)


SIMPLE_BASE = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?=[/?#]|$)"
PLAIN_BASE = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*/"
# A site path without characters that need escaping; a segment must not start with a dot either.
SIMPLE_PATH = r"^/(?![/\\])[A-Za-z0-9_~=&+,@%/?#:;!*.-]*$"
# What keeps a link from being taken as it is.
UNPLAIN = r"[^!-~]|[\"<>`{}\\]"


def _or_simple(base: Column, href: Column, general: Column) -> Column:
    """Most links are plain site paths on a plain host; they skip the general case."""
    simple = href.rlike(SIMPLE_PATH) & ~href.contains("/.")
    return (
        F.when(simple & base.rlike(PLAIN_BASE), F.concat(F.substring_index(base, "/", 3), href))
        .when(simple & base.rlike(SIMPLE_BASE), F.concat(F.regexp_extract(base, SIMPLE_BASE, 0), href))
        .otherwise(general)
    )


def abs_url(base: Column, href: Column) -> Column:
    """Resolve a link against the page it stands on; links that lead nowhere become blank."""
    return _or_simple(base, href, _abs_url(base, href))


def _abs_url(base: Column, href: Column) -> Column:

    def one(p: Column) -> Column:
        s = p["s"]
        return (
            F.when((s == "") | (s == "#") | s.startswith("javascript:") | s.startswith("void("), "")
            .when(s.contains(":") & s.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.when(s.rlike(r"(?i)^(data|blob|mailto|tel):"), "").otherwise(s))
            .otherwise(_resolve(p["b"], s))
        )

    return let(F.struct(text_or_blank(base).alias("b"), strip_space(text_or_blank(href)).alias("s")), one)


def book_url(url: Column, page_url: Column) -> Column:
    """Complete a link only when it is a site path; bare identifiers stay as they are."""

    def one(s: Column) -> Column:
        full = let(_abs_url(page_url, s), lambda u: F.when(u != "", u).otherwise(s))
        return F.when(s.rlike(r"^(\.{0,2}/)"), full).otherwise(s)

    return _or_simple(page_url, url, let(strip_space(text_or_blank(url)), one))


def url_valid(url: Column) -> Column:
    """Absolute http(s) address without quotes, brackets or white space."""
    s = strip_space(text_or_blank(url))
    return (
        s.rlike(r"(?i)^https?://")
        & ~s.rlike(rf"[\[\]\"'(){SPACE}]")
        & s.rlike(r"(?i)^https?://+([^/?#\\]*@)?[^/?#\\:@<>^|%]+(:([0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?)?([/?#\\]|$)")
    )


def host_of(url: Column) -> Column:
    """Host with port; the text before the first slash when the address does not parse."""
    s = text_or_blank(url)
    host = _host(s)
    fallback = F.substring_index(F.regexp_replace(s, "^https?://", ""), "/", 1)
    return F.when(s == "", "—").when(host != "", host).when(fallback != "", fallback).otherwise("—")


def first_url(c: Column) -> Column:
    """The first http(s) link inside a text."""
    return F.regexp_extract(text_or_blank(c), rf"https?://[^{SPACE}\"'<>\\]+", 0)


def unescape_slashes(c: Column) -> Column:
    return F.replace(text_or_blank(c), F.lit("\\/"), F.lit("/"))
