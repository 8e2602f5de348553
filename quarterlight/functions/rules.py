"""Keyword rules and small scalar models over columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterlight.functions import fixed_values as fixed


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])


def first_keyword(text: Column, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Label of the first keyword, in the mapping's order, that text contains."""
    return F.coalesce(*[F.when(text.contains(k), v) for k, v in labels.items()], F.lit(default))


def keyword_count(text: Column, keywords: Sequence[str]) -> Column:
    return sum((F.when(text.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))


def stance(text: Column, keywords: Mapping[str, Sequence[str]] = fixed.STANCE_KEYWORDS, default: str = "communication") -> Column:
    """Stance with most contained keywords, the first on ties; default if none is contained."""
    low = F.lower(text)
    counts = {name: keyword_count(low, words) for name, words in keywords.items()}
    most = F.greatest(*counts.values(), F.lit(0))
    return F.when(most == 0, default).otherwise(F.coalesce(*[F.when(n == most, name) for name, n in counts.items()]))


def instrument(text: Column, keywords: Mapping[str, Sequence[str]] = fixed.INSTRUMENT_KEYWORDS, default: str = "communication") -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(any_keyword(low, words), name) for name, words in keywords.items()], F.lit(default))


SIGNALS = ("speech", "testimony", "press_conference")


def action(doc_type: Column, stance_: Column, signals: Sequence[str] = SIGNALS) -> Column:
    by_stance = F.when(stance_ == "tightening", "tighten").when(stance_ == "easing", "ease").when(stance_ == "hold", "hold").otherwise("describe")
    return F.when(doc_type.isin(*signals), "signal").otherwise(by_stance)


def doc_type(text: Column, source_type: Column | None = None, keywords: Mapping[str, str] = fixed.DOC_KEYWORDS) -> Column:
    """Rules on the source's type, then patterns of the text, then keywords, the first hit each; else unknown."""
    low, source = F.lower(text), F.lower(source_type if source_type is not None else F.lit(""))
    by_source = (
        F.when(any_keyword(source, ["reserve_requirement", "open_market", "operation"]), "operation")
        .when(any_keyword(source, ["interest_rate", "key_rate"]), "decision").when(source.contains("report"), "report")
        .when(any_keyword(source, ["committee", "meeting"]), "minutes")
    )
    by_pattern = (
        F.when(low.rlike(r"monetary20\d{6}a"), "statement").when(low.contains("fomcminutes"), "minutes")
        .when(any_keyword(low, ["fomcproj", "projection"]), "projection").when(any_keyword(low, ["fomcpresconf", "press conference"]), "press_conference")
    )
    return F.coalesce(by_source, by_pattern, first_keyword(low, keywords, "unknown"))


def actor_country(text: Column, patterns=fixed.ACTOR_PATTERNS, default: tuple[str, str] = ("MULTI", "BIS")) -> Column:
    """Struct of country and actor of the first pattern row that the padded text contains."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    pair = lambda c, a: F.struct(F.lit(c).alias("country"), F.lit(a).alias("actor"))
    return F.coalesce(*[F.when(any_keyword(padded, words), pair(c, a)) for c, a, words in patterns], pair(*default))


def document_rank(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.endswith(".html") | low.endswith(".htm"), 0).when(low.endswith(".pdf"), 1).otherwise(2)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalize_probs(*raw: Column) -> list[Column]:
    """Clamped to [0, 1], nulls and NaN as 0, divided by their total; equal parts where that isn't positive."""
    clean = [clamp(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))) for x in raw]
    total = sum(clean[1:], clean[0])
    return [F.when(total <= 0, 1.0 / len(raw)).otherwise(x / total) for x in clean]


def argmax_class(probs: Sequence[Column], names: Sequence[str] = fixed.CLASSES) -> Column:
    most = F.greatest(*probs)
    return F.coalesce(*[F.when(p == most, n) for p, n in zip(probs, names)])


def taylor_rate(inflation: Column, growth: Column) -> Column:
    return 2.5 + inflation + 1.5 * (inflation - 2) + 0.5 * (growth - 2)


def band(x: Column, width: float, below: str, near: str, above: str) -> Column:
    return F.when(x > width, above).when(x < -width, below).otherwise(near)


def ect_signal(ect: Column) -> Column:
    return band(ect, 0.5, "below_equilibrium", "near_equilibrium", "above_equilibrium")


def taylor_signal(gap: Column) -> Column:
    return band(gap, 1.0, "too_tight", "near_rule", "too_loose")


def probs_from_delta(delta: Column) -> list[Column]:
    """Hike, hold and cut probabilities of a rate change."""
    s = clamp(delta / 0.25, -2.0, 2.0)
    hike, cut = 0.10 + F.greatest(F.lit(0.0), s), 0.10 + F.greatest(F.lit(0.0), -s)
    hold = 0.20 + F.greatest(F.lit(0.0), 1 - F.abs(s))
    total = hike + hold + cut
    return [hike / total, hold / total, cut / total]


def blend(a: Column, b: Column, weight: float) -> Column:
    return clamp(a * (1 - weight) + b * weight)


def stacked(parts: Sequence[Column]) -> Column:
    """Array without its nulls."""
    return F.array_compact(F.array(*parts))
