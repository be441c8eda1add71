"""URL normalising and classification as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from logtide.functions.choice import bound, first_of

# Schemes a URL may have and the ports they stand for.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "file": ""}

_URL = r"\A([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^#]*)"
_HOST_PORT = r"\A(?:.*@)?(\[[^\]]*\]|[^:@]*)(?::([0-9]*))?\z"


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, port and file (path and query) of a URL; empty where absent."""
    authority = F.regexp_extract(url, _URL, 2)
    return {  # as a struct it is worked out once; see `_of_parts`
        "scheme": F.lower(F.regexp_extract(url, _URL, 1)),
        "host": F.lower(F.regexp_extract(authority, _HOST_PORT, 1)),
        "port": F.regexp_extract(authority, _HOST_PORT, 2),
        "file": F.regexp_extract(url, _URL, 3),
    }


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user info or fragment; path and query as they are.

    Null for text that is not a URL of a known scheme.
    """
    def spelled(p: Column) -> Column:
        default = first_of([(p["scheme"] == scheme, F.lit(port)) for scheme, port in DEFAULT_PORTS.items()],
                           F.lit(None).cast("string"))
        port = F.when((p["port"] != "") & (p["port"] != default), F.concat(F.lit(":"), p["port"])).otherwise("")
        return F.when(p["scheme"].isin(*DEFAULT_PORTS), F.concat(p["scheme"], F.lit("://"), p["host"], port, p["file"]))

    return _of_parts(url, spelled)


def _of_parts(url: Column, use: Callable[[Column], Column]) -> Column:
    return bound(F.struct(*[part.alias(name) for name, part in url_parts(url).items()]), use)


def classify_endpoint(url: Column, endpoints: Iterable[tuple[str, str, Iterable[str] | None]]) -> Column:
    """The first endpoint (name, host, paths or None for any) a URL is for, by exact host and path."""
    def classified(p: Column) -> Column:
        path = F.lower(F.substring_index(p["file"], "?", 1))
        return first_of([(p["host"] == host if paths is None else (p["host"] == host) & path.isin(*paths), F.lit(name))
                         for name, host, paths in endpoints], F.lit(None).cast("string"))

    return _of_parts(url, classified)


def hosts_in(text: Column) -> Column:
    """Hosts of all URLs in a text, lower-cased, as an array."""
    # Fixed value: the schemes and characters of a host that count
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(?i)\b(?:https?|wss?|ftp)://([a-z0-9.-]+)"), 1), F.lower)
