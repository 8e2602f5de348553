"""Time-series operators over the orders' monthly panel by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.functions.dates import name_to_end, previous_quarter, quarter_end, quarter_name, quarter_range
from quarterlight.operators import timeseries as ts
from quarterlight.queries.registry import query, table

#: Sums in cents are exact in whatever order they are added.
MONTHS = """
m AS (SELECT o_orderpriority AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value, count(*)::BIGINT AS n
      FROM orders GROUP BY 1, 2)
"""
QUARTERS = f"""{MONTHS},
qf AS (SELECT entity, last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH) AS quarter_end, round(avg(value), 4) AS mean_value, arg_max(value, ts) AS last_value
       FROM m GROUP BY 1, 2),
g AS (SELECT entity, unnest(generate_series(date_trunc('quarter', min(quarter_end)), date_trunc('quarter', max(quarter_end)), INTERVAL 3 MONTH)) AS q FROM qf GROUP BY 1),
q AS (SELECT g.entity, last_day(g.q + INTERVAL 2 MONTH) AS quarter_end, mean_value, last_value
      FROM g LEFT JOIN qf ON g.entity = qf.entity AND last_day(g.q + INTERVAL 2 MONTH) = qf.quarter_end)
"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return orders.groupBy(F.col("o_orderpriority").alias("entity"), month.alias("ts")).agg((F.sum(cents).cast("double") / 100).alias("value"), F.count("*").alias("n"))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.resample_quarter(months(spark, sf_dir).withColumn("mean_value", F.col("value")).withColumn("last_value", F.col("value")), {"mean_value": "mean", "last_value": "last"})
    return out.withColumn("mean_value", F.round("mean_value", 4))


@query("resample_quarter", f"WITH {QUARTERS} SELECT entity, quarter_end, mean_value, last_value FROM q")
def _(spark, sf_dir):
    return quarters(spark, sf_dir)


@query("yoy_pct", f"WITH {QUARTERS} SELECT entity, quarter_end, round((mean_value / lag(mean_value, 4) OVER w - 1) * 100, 6) AS yoy FROM q WINDOW w AS (PARTITION BY entity ORDER BY quarter_end)")
def _(spark, sf_dir):
    return quarters(spark, sf_dir).select("entity", "quarter_end", F.round(ts.yoy_pct("mean_value"), 6).alias("yoy"))


@query("qoq_annualized", f"WITH {QUARTERS} SELECT entity, quarter_end, round((pow(mean_value / lag(mean_value) OVER w, 4) - 1) * 100, 4) AS qoq FROM q WINDOW w AS (PARTITION BY entity ORDER BY quarter_end)")
def _(spark, sf_dir):
    return quarters(spark, sf_dir).select("entity", "quarter_end", F.round(ts.qoq_annualized("mean_value"), 4).alias("qoq"))


@query("first_difference", f"WITH {QUARTERS} SELECT entity, quarter_end, round(mean_value - lag(mean_value) OVER w, 4) AS diff FROM q WINDOW w AS (PARTITION BY entity ORDER BY quarter_end)")
def _(spark, sf_dir):
    return quarters(spark, sf_dir).select("entity", "quarter_end", F.round(ts.first_difference("mean_value"), 4).alias("diff"))


@query("macro_quarterly_history", f"""WITH {MONTHS},
q AS (SELECT entity, last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH) AS quarter_end, avg(value) AS level, arg_max(n, ts)::DOUBLE AS rate FROM m GROUP BY 1, 2),
d AS (SELECT *, (level / lag(level, 4) OVER w - 1) * 100 AS yoy, rate - lag(rate) OVER w AS rate_qoq FROM q WINDOW w AS (PARTITION BY entity ORDER BY quarter_end))
SELECT entity, year(quarter_end)::VARCHAR || 'Q' || quarter(quarter_end)::VARCHAR AS quarter, round(level, 4) AS level, rate, round(yoy, 6) AS yoy, rate_qoq,
       round(yoy - lag(yoy) OVER (PARTITION BY entity ORDER BY quarter_end), 6) AS yoy_qoq, round(rate - yoy, 6) AS real_rate
FROM d WHERE quarter_end BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'""")
def _(spark, sf_dir):
    panel = months(spark, sf_dir).withColumn("level", F.col("value")).withColumn("rate", F.col("n").cast("double"))
    q = ts.resample_quarter(panel, {"level": "mean", "rate": "last"}).withColumn("yoy", ts.yoy_pct("level")).withColumn("rate_qoq", ts.first_difference("rate"))
    # the SQL filters before its last window, so the filter comes first here too
    kept = q.filter("quarter_end BETWEEN DATE'1996-01-01' AND DATE'2001-12-31'").withColumn("yoy_qoq", ts.first_difference("yoy"))
    return kept.select("entity", quarter_name(F.col("quarter_end")).alias("quarter"), F.round("level", 4).alias("level"), "rate", F.round("yoy", 6).alias("yoy"), "rate_qoq", F.round("yoy_qoq", 6).alias("yoy_qoq"), F.round(F.col("rate") - F.col("yoy"), 6).alias("real_rate"))


SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query("panel_outer_align", f"""WITH {QUARTERS}
SELECT quarter_end, max(CASE WHEN entity = '1-URGENT' THEN last_value END) AS urgent, max(CASE WHEN entity = '2-HIGH' THEN last_value END) AS high,
       max(CASE WHEN entity = '3-MEDIUM' THEN last_value END) AS medium, max(CASE WHEN entity = '5-LOW' THEN last_value END) AS low
FROM q GROUP BY 1 HAVING urgent IS NOT NULL AND low IS NOT NULL""")
def _(spark, sf_dir):
    long = quarters(spark, sf_dir).select("quarter_end", F.col("entity").alias("series"), F.col("last_value").alias("value"))
    wide = ts.outer_align(long, SERIES, ["1-URGENT", "5-LOW"])
    return wide.select("quarter_end", F.col("`1-URGENT`").alias("urgent"), F.col("`2-HIGH`").alias("high"), F.col("`3-MEDIUM`").alias("medium"), F.col("`5-LOW`").alias("low"))


@query("rate_direction", f"""WITH {MONTHS}, p AS (SELECT entity, ts, n AS rate, lag(n) OVER (PARTITION BY entity ORDER BY ts) AS previous FROM m)
SELECT entity, ts, rate, previous, CASE WHEN previous IS NULL THEN 'initial' WHEN rate > previous THEN 'increased' WHEN rate < previous THEN 'decreased' ELSE 'held' END AS direction,
       entity || ' ' || CASE WHEN previous IS NULL THEN 'initial' WHEN rate > previous THEN 'increased' WHEN rate < previous THEN 'decreased' ELSE 'held' END || ' at ' || format('{{:.2f}}', rate::DOUBLE) AS title
FROM p""")
def _(spark, sf_dir):
    df = ts.rate_direction(months(spark, sf_dir).select("entity", "ts", F.col("n").alias("rate")))
    return df.withColumn("title", F.format_string("%s %s at %.2f", "entity", "direction", F.col("rate").cast("double")))


@query("rate_change_points", f"""WITH {MONTHS} SELECT entity, ts, n AS rate FROM m QUALIFY coalesce(lag(n) OVER (PARTITION BY entity ORDER BY ts) <> n, true)""")
def _(spark, sf_dir):
    return ts.change_points(months(spark, sf_dir).select("entity", "ts", F.col("n").alias("rate")))


@query("error_correction_term", f"""WITH {QUARTERS} SELECT entity, quarter_end, round(lag(0.5 * mean_value - 0.25 * last_value) OVER (PARTITION BY entity ORDER BY quarter_end), 6) AS ect FROM q
QUALIFY lag(0.5 * mean_value - 0.25 * last_value) OVER (PARTITION BY entity ORDER BY quarter_end) IS NOT NULL""")
def _(spark, sf_dir):
    return ts.error_correction_term(quarters(spark, sf_dir), {"mean_value": 0.5, "last_value": -0.25}).select("entity", "quarter_end", F.round("ect", 6).alias("ect"))


@query("sequence_windows", f"""WITH {QUARTERS}, s AS (SELECT entity, quarter_end, list([mean_value, last_value]) OVER (PARTITION BY entity ORDER BY quarter_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS seq FROM q)
SELECT entity, quarter_end, seq[1][1] AS first_mean, seq[4][2] AS last_last, len(seq)::INTEGER AS length FROM s WHERE len(seq) = 4""")
def _(spark, sf_dir):
    s = ts.sequence_windows(quarters(spark, sf_dir), ["mean_value", "last_value"], 4, "entity", "quarter_end")
    return s.select("entity", "quarter_end", F.col("sequence")[0][0].alias("first_mean"), F.col("static")[1].alias("last_last"), F.size("sequence").alias("length"))


@query("quarter_functions", """SELECT o_orderkey, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS quarter,
  last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS quarter_end,
  year(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY)::VARCHAR || 'Q' || quarter(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY)::VARCHAR AS previous,
  len(generate_series(date_trunc('quarter', o_orderdate), TIMESTAMP '2001-10-01', INTERVAL 3 MONTH))::INTEGER AS quarters_left FROM orders""")
def _(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    df = table(spark, sf_dir, "orders").select("o_orderkey", quarter_name(day).alias("quarter"))
    return df.select("o_orderkey", "quarter", name_to_end(F.col("quarter")).alias("quarter_end"), previous_quarter(F.col("quarter")).alias("previous"), F.size(quarter_range(F.col("quarter"), F.lit("2001Q4"))).alias("quarters_left"))


#: Meetings: each order is one, with a decision by its status.
@query("meeting_label_frame", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'P' THEN 1 ELSE 0 END AS decision,
  last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS quarter_end FROM orders""")
def _(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    decision = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("date"), decision.alias("decision"), quarter_end(day).alias("quarter_end"))


UNPIVOT = """
f AS (SELECT s_nationkey AS country, p_type AS code, year(l_shipdate)::INTEGER AS year, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, code, year, value) of shipped value; the small tables may be broadcast by Spark."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
    joined = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("s_nationkey").alias("country"), F.col("p_type").alias("code"), F.year("l_shipdate").alias("year")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100).alias("value"))


@query("asof_latest_by_key", f"""WITH {UNPIVOT}, sparse AS (SELECT * FROM f WHERE (year + country) % 3 = 0),
grid AS (SELECT DISTINCT country, unnest(range(1995, 2002))::INTEGER AS year FROM f),
l AS (SELECT g.country, g.year, s.code, arg_max(s.value, s.year) AS value, max(s.year) AS seen FROM grid g JOIN sparse s ON s.country = g.country AND s.year <= g.year GROUP BY 1, 2, 3)
SELECT country, year, code, value, seen FROM l""")
def _(spark, sf_dir):
    facts = indicators(spark, sf_dir)
    grid = facts.select("country").distinct().select("country", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    sparse = facts.filter((F.col("year") + F.col("country")) % 3 == 0)
    out = ts.asof_grid(sparse, grid, ["country"], "code", "year", "value")
    return out.select("country", "year", F.explode("latest").alias("code", "v")).select("country", "year", "code", F.col("v.value").alias("value"), F.col("v.year").alias("seen"))


RELEVANCE = {"BRASS": 1.0, "STEEL": 0.8, "COPPER": 0.5}


def _scores(spark, sf_dir):
    from quarterlight.operators.coverage import indicator_scores

    return indicator_scores(indicators(spark, sf_dir), RELEVANCE, n_countries=25, n_years=7)


SCORES = f"""{UNPIVOT},
sc AS (SELECT code, round(count(DISTINCT country) / 25.0, 6) AS country_share, round(count(value) / (25.0 * 7), 6) AS cell_share,
              greatest(CASE WHEN contains(code, 'BRASS') THEN 1.0 ELSE 0.0 END, CASE WHEN contains(code, 'STEEL') THEN 0.8 ELSE 0.0 END, CASE WHEN contains(code, 'COPPER') THEN 0.5 ELSE 0.0 END)::DOUBLE AS relevance
       FROM f GROUP BY 1),
scored AS (SELECT code, country_share::DOUBLE AS country_share, cell_share::DOUBLE AS cell_share, relevance, round(0.5 * relevance + 0.3 * country_share::DOUBLE + 0.2 * cell_share::DOUBLE, 6) AS score FROM sc)
"""


@query("indicator_coverage_score", f"WITH {SCORES} SELECT * FROM scored")
def _(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("top_n_indicators", f"""WITH {SCORES}, t AS (SELECT code FROM scored ORDER BY score DESC, country_share DESC, cell_share DESC, code LIMIT 3) SELECT f.* FROM f SEMI JOIN t ON f.code = t.code""")
def _(spark, sf_dir):
    from quarterlight.operators.coverage import keep_top

    return keep_top(indicators(spark, sf_dir), _scores(spark, sf_dir), 3)


@query("coverage_audit", """WITH c AS (SELECT n_name AS country, year(o_orderdate)::INTEGER AS year, o_orderstatus AS kind FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT country, year, count(*)::BIGINT AS total, count_if(kind = 'F')::BIGINT AS n_f, count_if(kind = 'O')::BIGINT AS n_o, count_if(kind = 'P')::BIGINT AS n_p, CASE WHEN count(*) >= 5 THEN 'ok' ELSE 'thin' END AS grade FROM c GROUP BY 1, 2""")
def _(spark, sf_dir):
    from quarterlight.operators.coverage import audit

    return audit(documents_by_nation(spark, sf_dir), ["F", "O", "P"])


def documents_by_nation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("actor"))


@query("coverage_grid_join", """WITH c AS (SELECT n_name AS country, year(o_orderdate)::INTEGER AS year, o_orderpriority AS actor FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT n_name AS country, unnest(range(1994, 2003))::INTEGER AS year FROM nation)
SELECT g.country, g.year, count(c.actor)::BIGINT AS total FROM g LEFT JOIN c ON c.year = g.year AND (c.country = g.country OR (g.country = 'FRANCE' AND c.actor LIKE '1-%')) GROUP BY 1, 2""")
def _(spark, sf_dir):
    from quarterlight.operators.coverage import grid_counts

    countries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    return grid_counts(documents_by_nation(spark, sf_dir), countries, 1994, 2002, "FRANCE", "^1-")


@query("read_wide_csv", f"""WITH {UNPIVOT} SELECT country, code, year, value FROM f WHERE country IN (1, 3, 5, 7) AND year BETWEEN 1996 AND 2000""")
def _(spark, sf_dir):
    from quarterlight.scratch import scratch_path
    from quarterlight.sources.files import read_wide_csv

    path = scratch_path(spark, "wide")
    wide = indicators(spark, sf_dir).groupBy("country", "code").pivot("year", list(range(1995, 2002))).agg(F.first("value"))
    wide.write.option("header", True).csv(path)
    return read_wide_csv(spark, path, ["country", "code"], range(1996, 2001), F.col("country").isin("1", "3", "5", "7")).select(F.col("country").try_cast("int").alias("country"), "code", "year", "value")
