"""Queries over the given tables, with their SQL, by name."""

from quarterlight.queries import corpus, events, joins, metrics, models, panels, sources, streams, texts, traces  # noqa: F401
from quarterlight.queries.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "forecast_metrics"
