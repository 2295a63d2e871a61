"""URL scalars: canonical form, parts, shapes, sort keys, resolution."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, unquote, urldefrag, urlencode, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Parameters that name the visitor and not the resource.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid mc_cid mc_eid igshid "
    "ref referrer sid sessionid session_id phpsessid jsessionid"
).split()
#: Characters of a path that stay as they are, and the ports that go without saying.
_PATH_SAFE = "/~-._!$&'()*+,;=:@"
_PORTS = {"http": 80, "https": 443}
SKIPPED = "^(mailto:|javascript:|tel:|data:|#)"


def _resolve(path: str) -> str:
    """Dot segments and empty segments resolved; exactly two leading slashes stay two."""
    lead = "//" if path.startswith("//") and not path.startswith("///") else "/"
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if kept:
                kept.pop()
        elif part and part != ".":
            kept.append(part)
    return lead + "/".join(kept)


def canonical(url: str | None) -> str | None:
    """The canonical form of an http(s) url, None for anything else or an invalid one.

    User and fragment go, so do default ports, a host's last dot and tracking parameters; other
    parameters are sorted; a trailing slash stays.
    """
    if not url:
        return None
    try:
        at = urlsplit(url)
        port = at.port
    except ValueError:
        return None
    host = (at.hostname or "").lower()
    if at.scheme not in _PORTS or not host:
        return None
    if len(host) > 1 and host.endswith("."):
        host = host[:-1]
    if ":" in host:
        host = f"[{host}]"
    if port is not None and port != _PORTS[at.scheme]:
        host = f"{host}:{port}"
    path = quote(unquote(at.path or "/"), safe=_PATH_SAFE)
    path = path if path.startswith("/") else "/" + path
    clean = _resolve(path)
    if len(path) > 1 and path.endswith("/") and not clean.endswith("/"):
        clean += "/"
    pairs = sorted((k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if k.lower() not in TRACKING)
    return f"{at.scheme}://{host}{clean}" + (f"?{urlencode(pairs)}" if pairs else "")


def absolute(href: str | None, base: str) -> str | None:
    """``href`` against ``base`` without fragment; None unless it is a valid http(s) url."""
    if href is None:
        return None
    try:
        out = urldefrag(urljoin(base, href)).url
        at = urlsplit(out)
        at.port  # noqa: B018 - an invalid one raises
    except ValueError:
        return None
    return out if at.scheme in _PORTS and at.hostname else None


@arrow_udf(StringType())
def canonical_url(url: pa.Array) -> pa.Array:
    return pa.array([canonical(u) for u in url.to_pylist()], pa.string())


@arrow_udf(StringType())
def absolute_url(href: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([absolute(h, b or "") for h, b in zip(href.to_pylist(), base.to_pylist())], pa.string())


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?", group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host with port, user and case as written; empty without any."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def shape(url: Column) -> Column:
    """Authority and path with segments of digits alone made ``<num>``."""
    return F.concat(authority(url), F.array_join(F.transform(F.split(path(url), "/"), lambda s: F.when(s.rlike("^[0-9]+$"), "<num>").otherwise(s)), "/"))


def kept_query(url: Column) -> Column:
    """Parameters without tracking, sorted; for queries of plain characters."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    return F.array_join(F.array_sort(pairs), "&")


def surt(url: Column) -> Column:
    """Sort key: host labels reversed unless it is an address, port, path and query; no scheme."""
    host = F.lower(F.regexp_extract(authority(url), "(?:[^@]*@)?([^:]*)", 1))
    port = F.regexp_extract(authority(url), ":([0-9]+)$", 1)
    plain = host.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$")
    key = F.when(plain | (host == ""), host).otherwise(F.concat_ws(",", F.reverse(F.split(host, "\\."))))
    tail = F.when(path(url) == "", "/").otherwise(path(url))
    q = query(url)
    return F.concat(key, F.when((port != "") & (port != "0"), F.concat(F.lit(":"), port)).otherwise(""), F.lit(")"), tail, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


#: Limits of the trap guard: length, depth, repeats of one segment, parameters, urls of one shape.
LONG, DEEP, REPEATED, PARAMS, BUDGET = 2000, 12, 3, 12, 5


def trap(url: Column) -> Column:
    """Reason to refuse a url by itself, in order of the checks; null if there is none."""
    s, q = segments(url), query(url)
    most = F.array_max(F.transform(F.array_distinct(s), lambda x: F.size(F.filter(s, lambda y: y == x))))
    return (
        F.when(F.char_length(url) > LONG, "url_too_long")
        .when(F.size(s) > DEEP, "path_too_deep")
        .when(most > REPEATED, "repeated_segment")
        .when((q != "") & (F.size(F.split(q, "&")) > PARAMS), "too_many_params")
    )
