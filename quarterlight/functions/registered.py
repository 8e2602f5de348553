"""Functions that SQL text calls by name: table functions over pages and JSON records, and rewards."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarterlight.functions.fixed_values import REWARD_WEIGHTS
from quarterlight.operators.pages import PARSERS


class ParsePage:
    """parse_page(html, parser): what a registered parser finds in a page. The parser's name is a constant, and tells the columns: `plain` has text alone."""

    @staticmethod
    def analyze(html: AnalyzeArgument, parser: AnalyzeArgument) -> AnalyzeResult:
        if not parser.isConstantExpression or parser.value not in PARSERS:
            raise ValueError(f"parse_page: the parser must be one of {', '.join(sorted(PARSERS))}")
        names = ("text",) if parser.value == "plain" else ("title", "text", "published")
        schema = StructType()
        for name in names:
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str | None, parser: str) -> Iterator[tuple]:
        found = PARSERS[parser](html or "")
        yield (found[1],) if parser == "plain" else found


class JsonWalk:
    """json_walk(record, kind): (path, value) of a JSON record's leaves of a kind: string, number or boolean, a constant that tells the type of value. What isn't JSON has none."""

    KINDS = {"string": (str, StringType()), "number": ((int, float), DoubleType()), "boolean": (bool, BooleanType())}

    @staticmethod
    def analyze(record: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in JsonWalk.KINDS:
            raise ValueError(f"json_walk: the kind must be one of {', '.join(sorted(JsonWalk.KINDS))}")
        return AnalyzeResult(StructType().add("path", StringType()).add("value", JsonWalk.KINDS[kind.value][1]))

    def eval(self, record: str | None, kind: str) -> Iterator[tuple]:
        from quarterlight.operators.traces import _walk

        try:
            leaves = _walk(json.loads(record or "null"))
        except ValueError:
            return
        wanted = self.KINDS[kind][0]
        for path, value in leaves:
            if isinstance(value, wanted) and (kind == "boolean" or not isinstance(value, bool)):
                yield path, float(value) if kind == "number" else value


_TOTAL = sum(abs(w) for w in REWARD_WEIGHTS.values())
#: Rewards by name: parameters and body of a SQL function. They score as reward_components does, column by column.
REWARDS = {
    "reward_probability_calibrated": (
        "hike DOUBLE, hold DOUBLE, cut DOUBLE, actual STRING",
        "CASE WHEN actual IS NULL THEN 0D ELSE round(greatest(-1D, 1 - (power(coalesce(hike, 0D) - if(actual = 'hike_25bp', 1D, 0D), 2) + power(coalesce(hold, 0D) - if(actual = 'hold', 1D, 0D), 2) + power(coalesce(cut, 0D) - if(actual = 'cut_25bp', 1D, 0D), 2))), 6) END",
    ),
    "reward_no_future_leakage": ("mentions INT", "CASE WHEN mentions IS NULL THEN 0D WHEN mentions = 0 THEN 1D ELSE greatest(-1D, -0.25D * mentions) END"),
    "reward_lower_regret": ("regret DOUBLE", "CASE WHEN regret IS NULL THEN 0D ELSE round(greatest(-1D, 1 - 4 * greatest(0D, regret)), 6) END"),
    "reward_fewer_rounds": ("rounds INT", "CASE WHEN rounds IS NULL THEN 0D ELSE round(greatest(-1D, least(1D, 1 - (greatest(1D, CAST(rounds AS DOUBLE)) - 1) / 20)), 6) END"),
    "reward_stability": ("converged BOOLEAN, stable_rounds INT", "CASE WHEN converged THEN 1D WHEN stable_rounds IS NULL THEN 0D WHEN stable_rounds >= 10 THEN 1D ELSE round(CAST(stable_rounds AS DOUBLE) / 10 - 0.5D, 6) END"),
    "reward_weighted": (
        "scores MAP<STRING, DOUBLE>",
        "round(" + " + ".join(f"coalesce(scores['{name}'], 0D) * {float(weight)}D" for name, weight in REWARD_WEIGHTS.items()) + ", 12) / " + f"nullif(round({' + '.join(f'''if(map_contains_key(scores, '{name}'), {abs(float(weight))}D, 0D)''' for name, weight in REWARD_WEIGHTS.items())}, 12), 0D)",
    ),
}


def register(spark: SparkSession) -> None:
    """Makes parse_page, json_walk and the rewards known to the session's SQL."""
    spark.udtf.register("parse_page", F.udtf(ParsePage))
    spark.udtf.register("json_walk", F.udtf(JsonWalk))
    for name, (parameters, body) in REWARDS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
