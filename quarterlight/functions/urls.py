"""URLs and links in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: Column) -> Column:
    """Without fragment, with a path of at least /; null unless http or https."""
    bare = F.regexp_replace(url, "#.*$", "")
    rooted = F.regexp_replace(bare, r"^(https?://[^/?#]+)(\?|$)", "$1/$2")
    return F.when(F.lower(url).rlike("^https?://"), rooted)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_allowed(url: Column, depth: Column, max_depth: int, host: Column | None = None, deny: list[str] | None = None, allow: list[str] | None = None, seed: Column | None = None) -> Column:
    """Scheme, depth, host, denied and allowed patterns; a seed needn't match an allowed pattern."""
    fits = F.lower(url).rlike("^https?://") & (depth <= max_depth)
    if host is not None:
        fits &= url_host(url) == host
    for pattern in deny or []:
        fits &= ~url.rlike(pattern)
    if allow:
        some = url.rlike("|".join(f"(?:{p})" for p in allow))
        fits &= some if seed is None else some | seed
    return fits


def absolute_url(base: Column, href: Column) -> Column:
    """href resolved against base: absolute, rooted or relative to the base's folder; the fragment goes."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    full = F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    return F.regexp_replace(full, "#.*$", "")


def links(html: Column) -> Column:
    """Array of href and anchor text of each anchor with text."""
    pattern = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))
    named = F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), F.trim(F.regexp_replace(F.regexp_replace(p["inner"], "<[^>]+>", " "), r"\s+", " ")).alias("text")))
    return F.filter(named, lambda p: p["text"] != "")
