"""URL scalar functions (OP-10 to OP-13) as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: groups: 1 scheme, 2 authority, 3 path, 4 query (with ``?``); the fragment is matched and left out
URL_PATTERN = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
#: stands between the pieces of a URL that was cut
CUT = "\x01"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, group)


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and leading ``www.``; null for a null or unparsable url."""
    authority = F.lower(_part(url, 2))
    bare = F.regexp_replace(authority, r"^(?:[^@]*@)?(?:www\.)?|:\d*$", "")
    return F.when(bare != "", bare)


def _decoded(text: Column) -> Column:
    """Percent-decoded text; ``+`` stays, and a malformed escape leaves the whole text as it is."""
    plain = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.when(F.contains(text, F.lit("%")), plain).otherwise(text)


def _canonical_parameter(pair: Column) -> Column:
    """``name=value`` with both sides decoded and encoded again."""
    name, value = F.substring_index(pair, "=", 1), F.when(F.contains(pair, F.lit("=")), F.regexp_replace(pair, r"^[^=]*=", "")).otherwise(F.lit(""))
    again = lambda c: F.coalesce(F.url_encode(F.try_url_decode(c)), c)
    return F.when(pair.rlike("[%+]"), F.concat(again(name), F.lit("="), again(value))).otherwise(F.concat(name, F.lit("="), value))


def _sorted_query(query: Column) -> Column:
    """The parameters sorted by name; equal names keep their order, as a stable sort would."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(_canonical_parameter(p), "=", 1).alias("n"), i.alias("i"), _canonical_parameter(p).alias("p")))
    many = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    simple = query.rlike(r"^[^&%+=]+=[^&%+]*$")
    return F.when(simple, query).otherwise(many)


def url_pieces(url: Column) -> Column:
    """[empty, authority, path, query with ``?``] of a URL by one match; an array of another size for what is no URL."""
    return F.split(F.regexp_replace(url, URL_PATTERN, f"{CUT}$2{CUT}$3{CUT}$4"), CUT)


def host_from(pieces: Column) -> Column:
    authority = F.lower(F.get(pieces, 1))
    plain = authority.rlike(r"^[^@:]*$")
    bare = F.when(plain, F.when(F.startswith(authority, F.lit("www.")), F.substring(authority, 5, 1 << 30)).otherwise(authority)).otherwise(F.regexp_replace(authority, r"^(?:[^@]*@)?(?:www\.)?|:\d*$", ""))
    return F.when(bare != "", bare)


def normal_from(url: Column, pieces: Column) -> Column:
    """What :func:`normalize_url` gives, of a URL whose pieces are at hand."""
    path = F.replace(_decoded(F.get(pieces, 2)), F.lit("//"), F.lit("/"))
    path = F.when(F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    query = F.substring(F.get(pieces, 3), 2, 1 << 30)
    full = F.concat(F.coalesce(host_from(pieces), F.lit("")), path, F.when(query != "", F.concat(F.lit("?"), _sorted_query(query))).otherwise(F.lit("")))
    return F.when(F.size(pieces) == 4, full).otherwise(F.trim(url))


def normalize_url(url: Column) -> Column:
    """OP-11: host in lower case without ``www.`` and port, decoded path with ``//`` made ``/`` and one trailing ``/``
    dropped, parameters sorted by name; scheme and fragment dropped. Null for null; a text that is no URL stays as it is,
    trimmed."""
    path = F.replace(_decoded(_part(url, 3)), F.lit("//"), F.lit("/"))
    path = F.when(F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    query = F.substring(_part(url, 4), 2, 1 << 30)
    full = F.concat(F.coalesce(url_host(url), F.lit("")), path, F.when(query != "", F.concat(F.lit("?"), _sorted_query(query))).otherwise(F.lit("")))
    return F.when(url.rlike(URL_PATTERN), full).otherwise(F.trim(url))


def with_normal_url(df: DataFrame, url: str, name: str = "norm_url") -> DataFrame:
    """The table with a column of :func:`normalize_url`; each URL is matched once, in a projection of its own, which is faster
    where many rows have one."""
    rest = df.columns
    cut = df.select(*rest, url_pieces(F.col(url)).alias("__pieces"))
    return cut.select(*[c for c in rest if c != name], normal_from(F.col(url), F.col("__pieces")).alias(name))


def root_url(url: Column) -> Column:
    """OP-13: ``scheme://host/`` with the host as written."""
    return F.when(url.rlike(URL_PATTERN), F.concat(_part(url, 1), F.lit("://"), _part(url, 2), F.lit("/")))


def same_origin(link_host: Column, base_host: Column) -> Column:
    """OP-12: the base host contains the link's host; a substring test and not symmetric."""
    return F.contains(base_host, link_host)


def absolute_url(href: Column, base: Column) -> Column:
    """OP-10: a link made absolute against its page, without fragment; null unless the result is https.

    Covers absolute, protocol-relative, root-relative, query-only and path-relative links with ``.`` and ``..`` segments.
    """
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.regexp_replace(root_url(base), "/$", "")
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    relative = F.concat(root, _without_dots(F.concat(folder, link)))
    out = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, _without_dots(link)))
        .when(F.startswith(link, F.lit("?")), F.concat(root, _part(base, 3), link))
        .otherwise(relative)
    )
    usable = (F.trim(href) != "") & ~F.startswith(F.trim(href), F.lit("#")) & ~F.startswith(F.lower(F.trim(href)), F.lit("javascript:"))
    return F.when(usable & F.startswith(out, F.lit("https://")), out)


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved; the query is left alone."""
    before, query = F.substring_index(path, "?", 1), F.regexp_extract(path, r"\?.*$", 0)
    parts = F.split(before, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, p)),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    resolved = F.concat(F.array_join(kept, "/"), tail)
    return F.concat(F.when(F.contains(before, F.lit("./")) | F.endswith(before, F.lit("/.")) | F.endswith(before, F.lit("/..")), resolved).otherwise(before), query)
