"""Links: split, resolve against a base address, and take the file name.

All of it is regular expressions and array functions, so it fuses into the scan of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic split of an address into scheme, authority, path, query and fragment.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, f"(?s){PARTS}", index)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    kept = F.reduce(
        segments,
        F.array(F.lit("")).cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    # The seed is one empty segment, and an absolute path splits into one more.
    joined = F.regexp_replace(F.array_join(kept, "/"), "^//", "/")
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    resolved = F.regexp_replace(F.concat(joined, tail), "/+$", "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as an absolute address, seen from the page ``base``."""
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    base_path = _part(base, 3)
    folder = F.when(base_path.contains("/"), F.regexp_replace(base_path, "[^/]*$", "")).otherwise("/")
    path, query, fragment = _part(href, 3), _part(href, 4), _part(href, 5)
    rooted = F.when(path.startswith("/"), path).otherwise(
        F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
    )
    return (
        F.when(href == "", base)
        .when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(path != "", F.concat(origin, _without_dots(rooted), query, fragment))
        .when(query != "", F.concat(origin, base_path, query, fragment))
        .otherwise(F.concat(origin, base_path, _part(base, 4), fragment))
    )


def file_name(url: Column, default: str = "download.csv") -> Column:
    """The decoded last path segment of an address."""
    path = F.regexp_replace(_part(url, 3), ";[^/]*$", "")
    raw = F.regexp_extract(path, "([^/]+)/*$", 1)
    # A plus sign is a plain character in a path, but form decoding would turn it into a blank.
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    return F.when(decoded == "", default).otherwise(decoded)


def hrefs(html: Column, pattern: str) -> Column:
    """All matches of the first group of ``pattern``, in page order."""
    return F.regexp_extract_all(html, F.lit(f"(?i){pattern}"), F.lit(1))


def links(html: Column, base: Column, pattern: str) -> Column:
    """Distinct absolute links in page order.

    ``array_distinct`` keeps the first of equal values, so no shuffle is needed per page.
    """
    return F.array_distinct(F.transform(hrefs(html, pattern), lambda href: resolve(base, href)))
