"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _col, trim_space

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?([^?#]*)"


def canonical_url(c: ColumnOrName) -> Column:
    """Origin and path: no query and fragment, lower-case scheme and host, no default port, a path of '/' at least. What doesn't parse stays as it is."""
    c = _col(c)
    scheme, host = F.lower(F.regexp_extract(c, _PARTS, 1)), F.lower(F.regexp_extract(c, _PARTS, 2))
    port, path = F.regexp_extract(c, _PARTS, 3), F.regexp_extract(c, _PARTS, 4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    whole = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))
    return F.when(c.rlike(_PARTS), whole).otherwise(c)


def post_key(c: ColumnOrName) -> Column:
    """One key for all spellings of a post's URL: canonical, without a final slash, the first ``/reels/`` as ``/reel/``."""
    bare = F.regexp_replace(canonical_url(c), "/+$", "")
    return F.regexp_replace(bare, r"^(.*?)/reels/", "$1/reel/")


def url_variants(c: ColumnOrName) -> Column:
    """The spellings that a post may be stored under: with and without slash, ``reel`` and ``reels``."""
    bare = F.regexp_replace(canonical_url(c), "/+$", "")
    one = F.regexp_replace(bare, r"^(.*?)/reels/", "$1/reel/")
    many = F.regexp_replace(bare, r"^(.*?)/reel/", "$1/reels/")
    return F.array_distinct(F.flatten(F.array(*[F.array(u, F.concat(u, F.lit("/"))) for u in (bare, one, many)])))


def instagram_url(c: ColumnOrName) -> Column:
    """https, host www.instagram.com, no query, fragment or final slashes; other URLs stay as they are."""
    cleaned = trim_space(c)
    cleaned = F.when(cleaned.startswith("http"), cleaned).otherwise(F.concat(F.lit("https://"), cleaned))
    host, path = F.lower(F.regexp_extract(cleaned, _PARTS, 2)), F.regexp_replace(F.regexp_extract(cleaned, _PARTS, 4), "/+$", "")
    found = F.concat(F.lit("https://www.instagram.com"), F.when(path == "", "/").otherwise(path))
    return F.when(F.contains(host, F.lit("instagram.com")), found).otherwise(_col(c))


def platform(c: ColumnOrName) -> Column:
    """``tiktok`` or, of anything else, ``instagram``."""
    return F.when(F.contains(_col(c), F.lit("tiktok.com")), "tiktok").otherwise("instagram")


def strict_platform(c: ColumnOrName) -> Column:
    """``tiktok``, ``instagram`` or null."""
    return F.when(F.contains(_col(c), F.lit("tiktok.com")), "tiktok").when(F.contains(_col(c), F.lit("instagram.com")), "instagram")


def uri_encode(c: ColumnOrName) -> Column:
    """Percent-encoding with blanks as %20."""
    return F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
