"""Document titles that follow from a document's URL and date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterlight.functions.rules import any_keyword

# Substrings of the lower-case URL and the title that stands for them, first row first.
TITLE_RULES = [
    (["fomcminutes"], "FOMC minutes"),
    (["pressreleases/monetary20", "files/monetary20"], "FOMC statement"),
    (["fomcpresconf"], "FOMC press conference"),
    (["meeting.pdf"], "FOMC transcript"),
    (["sep", "fomcprojtabl"], "FOMC SEP"),
]


def normalize_title(title: Column, url: Column, date: Column, rules: Sequence[tuple[list[str], str]] = TITLE_RULES, note: tuple[str, str, str] = ("FOMC statement", "implementation", "FOMC implementation note")) -> Column:
    """Title by the URL's rule, with the date, and the format where the title is only that; else the trimmed title.

    note: under its first title, a title with the second word (or a URL that ends in b.htm) is the third.
    """
    short, low = F.trim(title), F.lower(url)
    suffix = F.when(F.lower(short).isin("html", "pdf"), F.concat(F.lit(" ("), F.upper(short), F.lit(")"))).otherwise("")
    named = F.lit(None).cast("string")
    for words, name in reversed(list(rules)):
        name_ = F.lit(name)
        if name == note[0]:
            name_ = F.when(F.lower(short).contains(note[1]) | low.endswith("b.htm"), note[2]).otherwise(name)
        named = F.when(any_keyword(low, words), F.trim(F.concat(name_, F.lit(" "), F.coalesce(date, F.lit("")), suffix))).otherwise(named)
    return F.coalesce(named, short)
