"""Strategy, belief and forecast arithmetic of stored decision traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterlight.functions.rules import clamp

# Fields of a strategy.
STRATEGY = (
    "hawkish_signal_prob", "rate_hike_25bp_prob", "hold_with_hawkish_statement_prob", "remove_forward_guidance_prob",
    "easing_signal_prob", "liquidity_support_prob", "trade_or_sanction_pressure_prob",
)
# Fields of a strategy whose rise is hawkish pressure, whose fall is, and of external pressure.
HAWKISH, DOVISH, EXTERNAL = STRATEGY[:4], STRATEGY[4:6], STRATEGY[6:]


# The coefficients and bounds of belief, belief_from_text and fomc_path.


def belief(b: Mapping[str, Column]) -> dict[str, Column]:
    """Beliefs of a briefing (ect, gap, inflation, unemployment, energy, credibility), by linear rules and clamped."""
    zero = F.lit(0.0)
    excess, pressure = F.greatest(zero, b["inflation"] - 2.0) / 6.0, F.greatest(zero, b["gap"]) / 4.0
    hawkish = 0.1 + 0.35 * pressure
    labor = 0.15 + 0.20 * F.greatest(zero, (4.5 - b["unemployment"]) / 3.0)
    return {
        "inflation_persistence": clamp(0.25 + 0.45 * excess + 0.20 * pressure + 0.10 * F.greatest(zero, -b["ect"] / 5.0)),
        "labor_softening": clamp(1.0 - labor),
        "energy_shock_risk": clamp(0.2 + 0.15 * b["energy"]),
        "geopolitical_escalation": clamp(0.3 + 0.1 * hawkish),
        "dollar_liquidity_pressure": clamp(0.25 + 0.1 * (b["gap"] / 4.0)),
        "policy_credibility_risk": clamp(b["credibility"] + 0.25 * F.greatest(zero, b["inflation"] - 2.0) / 5.0),
    }


def belief_from_text(text: Column) -> dict[str, Column]:
    """Beliefs of a context's words where there is no briefing."""
    low = F.lower(text)
    has = lambda *words: F.when(sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0, 1).otherwise(0)
    return {
        "inflation_persistence": 0.55 + 0.18 * has("inflation", "cpi"),
        "labor_softening": 0.28 + 0.14 * has("unemployment", "labor"),
        "energy_shock_risk": 0.25 + 0.18 * has("energy", "oil"),
        "geopolitical_escalation": 0.25 + 0.20 * has("sanction", "war", "geopolitical"),
        "dollar_liquidity_pressure": 0.20 + 0.15 * has("liquidity", "dollar"),
        "policy_credibility_risk": 0.45 + 0.20 * has("target", "credibility"),
    }


def fomc_path(hike_prob: Column, easing_prob: Column, b: Mapping[str, Column], digits: int = 4) -> list[Column]:
    """Hike, hold and cut of a strategy and beliefs: linear scores, clamped and normalised."""
    inflation, labor, energy, credibility = (b[k] for k in ("inflation_persistence", "labor_softening", "energy_shock_risk", "policy_credibility_risk"))
    hike = clamp(0.02 + 0.55 * hike_prob + 0.30 * inflation + 0.10 * credibility + 0.08 * energy - 0.10 * labor, 0.0, 0.95)
    cut = clamp(0.02 + 0.35 * easing_prob + 0.30 * labor - 0.25 * inflation - 0.10 * credibility, 0.0, 0.60)
    hold = F.greatest(F.lit(0.0), 1.0 - hike - cut)
    total = hike + hold + cut
    return [F.round(x / total, digits) for x in (hike, hold, cut)]


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Largest absolute difference of the fields."""
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b)], F.lit(0.0))


def override_value(text: Column) -> Column:
    """Tagged value of an override: kind bool, null, float, int or string, and the value as text."""
    t, low = F.trim(text), F.lower(F.trim(text))
    number = F.when(low.rlike(r"[.e]"), t.try_cast("double").isNotNull()).otherwise(t.try_cast("bigint").isNotNull())
    kind = F.when(low.isin("true", "false"), "bool").when(low.isin("none", "null"), "null").when(number & low.rlike(r"[.e]"), "float").when(number, "int").otherwise("string")
    value = F.when(kind == "bool", low).when(kind == "float", t.try_cast("double").cast("string")).when(kind != "null", t)
    return F.struct(kind.alias("kind"), value.alias("value"))


def clamp_answer(value: Column, default: float, low: float = 0.0, high: float = 1.0, digits: int = 4) -> Column:
    """A number out of free text: default where it isn't one, clamped and rounded."""
    number = value.try_cast("double")
    return F.round(clamp(F.when(F.isnan(number), default).otherwise(F.coalesce(number, F.lit(default))), low, high), digits)
