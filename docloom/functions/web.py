"""Column functions for URLs and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_private_host(host: Column) -> Column:
    """Loopback, private, link-local and unspecified addresses, and local names."""
    return host.rlike(r"(?i)^(localhost|.*\.local|.*\.internal|127(\.\d+){3}|10(\.\d+){3}|192\.168(\.\d+){2}|172\.(1[6-9]|2\d|3[01])(\.\d+){2}|169\.254(\.\d+){2}|0(\.\d+){3}|\[?::1?\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe[89ab][0-9a-f]:.*)$")


def is_http_base(url: Column) -> Column:
    """Whether a URL may be the base of others: http(s), a public host, no user, query or fragment."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return F.coalesce(F.lower(part("PROTOCOL")).isin("http", "https") & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull() & part("HOST").isNotNull() & ~is_private_host(part("HOST")), F.lit(False))


def to_utc(c: Column) -> Column:
    """RFC 3339 and RFC 822 dates as UTC timestamps; null for all else."""
    stripped = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(stripped, r"\s(GMT|UTC|UT|Z)$", " +0000")
    tries = [F.try_to_timestamp(F.trim(c))] + [F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    return F.coalesce(*tries)
