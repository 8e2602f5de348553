"""Text: normal forms, hashes, tokens, sentences, numbers and dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """Tags become spaces, white space collapses."""
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a pipe."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-case, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct space-separated words of more than two characters; underscores and hyphens part words."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(text), "_-", "  "), r"\s+"), lambda w: F.length(w) > 2))


def sentences(text: Column) -> Column:
    """Lower-case sentences, parted after . ! ? ; and white space."""
    return F.filter(F.split(collapse(F.lower(text)), r"(?<=[.!?;])\s+"), lambda s: s != "")


def parse_number(text: Column) -> Column:
    """First signed decimal after commas are dropped; null for - and nan."""
    bare = F.lower(F.trim(F.translate(text, ",", "")))
    return F.when(~bare.isin("-", "nan", ""), F.regexp_extract(bare, r"-?\d+(?:\.\d+)?", 0).try_cast("double"))


def magnitude_bp(title: Column) -> Column:
    """Basis points: `N bp` or `N basis points`, else a percentage times 100, cut to an integer."""
    points = F.regexp_extract(title, r"(?i)(\d{1,3})\s*(?:basis points|bp)", 1).try_cast("int")
    percent = (F.regexp_extract(title, r"(\d(?:\.\d+)?)\s*%", 1).try_cast("double") * 100).cast("int")
    return F.coalesce(points, percent)


def canonical_title(title: Column) -> Column:
    bare = F.regexp_replace(title, r"(?i)\s+\((?:PDF|HTML)\)\s*$", "")
    return collapse(F.regexp_replace(bare, r"(?i):\s*(?:PDF|HTML)\s*$", ""))


def iso_date(text: Column) -> Column:
    """First YYYY-MM-DD or YYYY/MM/DD, with hyphens; null if there is none."""
    found = F.regexp_extract(text, r"\d{4}[-/]\d{2}[-/]\d{2}", 0)
    return F.when(found != "", F.translate(found, "/", "-"))


# The names of months and the forms of dates below.
MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"


def infer_date(text: Column, fallback_year: Column | None = None) -> Column:
    """YYYYMMDD, then Y-M-D or Y/M/D, then `Month d, yyyy`; an invalid date is passed over; else January 1st of the fallback year."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    packed, parted = r"((?:19|20)\d{2})(\d{2})(\d{2})", r"((?:19|20)\d{2})[-/](\d{1,2})[-/](\d{1,2})"
    worded = rf"(?i)\b({MONTH_NAMES})\s+(\d{{1,2}}),?\s+((?:19|20)\d{{2}})"
    digits = lambda p: F.try_to_date(F.concat_ws("-", part(p, 1), F.lpad(part(p, 2), 2, "0"), F.lpad(part(p, 3), 2, "0")), "yyyy-MM-dd")
    named = F.try_to_date(F.concat_ws(" ", F.initcap(part(worded, 1)), part(worded, 2), part(worded, 3)), "MMMM d yyyy")
    found = [F.when(part(packed, 0) != "", digits(packed)), F.when(part(parted, 0) != "", digits(parted)), F.when(part(worded, 0) != "", named)]
    if fallback_year is not None:
        found.append(F.make_date(fallback_year, F.lit(1), F.lit(1)))
    return F.coalesce(*found)


def key_values(text: Column) -> Column:
    """Map of all key=number pairs in text; the last of a key holds."""
    pattern = r"([A-Za-z_][A-Za-z0-9_]*)=(-?\d+(?:\.\d+)?)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,double>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"].try_cast("double"))))
    return last


def metric(metrics: Column, names: list[str], default: float = 0.0) -> Column:
    """First present of the names in the map."""
    return F.coalesce(*[metrics[n] for n in names], F.lit(default))


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)
