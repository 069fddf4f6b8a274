"""URL parsing, normalisation and resolution as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^([^:]*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# percent codes of the unreserved characters A-Z a-z 0-9 - . _ ~
_UNRESERVED = r"(?i)^%(?:2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once: a bound variable in place of copies of its expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def is_valid(url: Column) -> Column:
    """http or https (any case) with a non-empty authority."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]"), F.lit(False))


def components(url: Column) -> Column:
    """Struct (scheme, authority, host, port, path, query, fragment); null if invalid.

    The authority is split at its first colon; an empty path is ``/``.
    """
    authority = _part(url, 2)
    path = _part(url, 3)
    parts = F.struct(
        F.lower(_part(url, 1)).alias("scheme"), authority.alias("authority"),
        F.lower(F.substring_index(authority, ":", 1)).alias("host"),
        F.regexp_extract(authority, "^[^:]*:(.*)$", 1).alias("port"),
        F.when(path == "", "/").otherwise(path).alias("path"),
        _part(url, 4).alias("query"), _part(url, 5).alias("fragment"),
    )
    return F.when(is_valid(url), parts)


def decode_unreserved(path: Column) -> Column:
    """Percent codes of unreserved characters decoded in a single pass; all others stay."""
    pieces = F.regexp_extract_all(path, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    one = lambda p: F.when(p.rlike(_UNRESERVED), F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).otherwise(p)
    return F.when(F.contains(path, F.lit("%")), F.array_join(F.transform(pieces, one), "")).otherwise(path)


def normalize(url: Column) -> Column:
    """Canonical form, or an empty string for an invalid URL; null stays null.

    Lower-case scheme and host, default port and fragment dropped, unreserved codes
    in the path decoded, one trailing slash removed, empty query and port dropped.
    """
    authority, path, query = _part(url, 2), _part(url, 3), _part(url, 4)
    scheme, host = F.lower(_part(url, 1)), F.lower(F.substring_index(authority, ":", 1))
    port = F.regexp_extract(authority, "^[^:]*:(.*)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    decoded = decode_unreserved(F.when(path == "", "/").otherwise(path))
    trimmed = F.regexp_replace(decoded, "(?s)^(.+)/$", "$1")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), trimmed, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.isNull(), None).when(is_valid(url), out).otherwise("")


def domain(url: Column) -> Column:
    """Host without port in lower case; empty if the URL is invalid."""
    return F.when(url.isNull(), None).when(is_valid(url), F.lower(F.substring_index(_part(url, 2), ":", 1))).otherwise("")


def remove_dot_segments(path: Column) -> Column:
    """Path without ``.``, ``..`` and empty segments, always rooted, never with a trailing slash."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((x == "") | (x == "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def resolve(base: Column, rel: Column) -> Column:
    """Absolute, normalised form of ``rel`` found in a page at ``base``; empty if the base is invalid."""
    authority = _part(base, 2)
    scheme, host = F.lower(_part(base, 1)), F.lower(F.substring_index(authority, ":", 1))
    port = F.regexp_extract(authority, "^[^:]*:(.*)$", 1)
    root = F.concat(scheme, F.lit("://"), host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)))
    path = _part(base, 3)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), "(?s)^(.*/)[^/]*$", 1)
    link = (
        F.when(rel.rlike("^https?://"), rel)
        .when(~is_valid(base), "")
        .when(rel.startswith("//"), F.concat(scheme, F.lit(":"), rel))
        .when(rel.startswith("/"), F.concat(root, remove_dot_segments(rel)))
        .otherwise(F.concat(root, remove_dot_segments(F.concat(folder, rel))))
    )
    return _once(link, normalize)


def robots_path(url: Column) -> Column:
    """From the first slash after ``://`` to the end, query included; ``/`` if there is none."""
    path = F.regexp_extract(url, "(?s)://[^/]*(/.*)$", 1)
    return F.when(path == "", "/").otherwise(path)
