"""As-of, lagged and panel joins over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlight.functions.dates import quarter_name
from quarterlight.operators import timeseries as ts
from quarterlight.queries.metrics import LABELS, day_labels
from quarterlight.queries.panels import MONTHS, QUARTERS, months, quarters
from quarterlight.queries.registry import query, table


@query("asof_features_join", """WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, v.ts AS seen, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    left = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return ts.asof_join(left, right, ["user_id"], "ts", "seen", ["value"]).select("event_id", "user_id", F.col("matched_seen").alias("seen"), "value")


@query("briefing_asof", f"""WITH {QUARTERS}, d AS (SELECT o_orderkey, o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT d.o_orderkey, coalesce(q.mean_value, 1.0)::DOUBLE AS mean_value, coalesce(q.last_value, 2.0)::DOUBLE AS last_value FROM d ASOF LEFT JOIN q ON d.entity = q.entity AND d.day >= q.quarter_end""")
def _(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("entity"), F.col("o_orderdate").cast("date").alias("day"))
    met = ts.asof_join(left, quarters(spark, sf_dir), ["entity"], "day", "quarter_end", ["mean_value", "last_value"], keep_unmatched=True)
    return met.select("o_orderkey", F.coalesce("mean_value", F.lit(1.0)).alias("mean_value"), F.coalesce("last_value", F.lit(2.0)).alias("last_value"))


@query("varx_inner_join", f"""WITH {QUARTERS}, r AS (SELECT entity, quarter_end, mean_value - lag(mean_value) OVER w AS resid FROM q WINDOW w AS (PARTITION BY entity ORDER BY quarter_end)),
e AS (SELECT entity, quarter_end, lag(last_value) OVER (PARTITION BY entity ORDER BY quarter_end) AS ect FROM q)
SELECT q.entity, q.quarter_end, round(resid, 4) AS resid, ect FROM q JOIN r ON q.entity = r.entity AND q.quarter_end = r.quarter_end JOIN e ON q.entity = e.entity AND q.quarter_end = e.quarter_end WHERE mean_value IS NOT NULL AND resid IS NOT NULL AND ect IS NOT NULL""")
def _(spark, sf_dir):
    q = quarters(spark, sf_dir)
    resid = q.select("entity", "quarter_end", F.round(ts.first_difference("mean_value"), 4).alias("resid"))
    ect = q.select("entity", "quarter_end", ts.lagged("last_value", 1).alias("ect"))
    keys = ["entity", "quarter_end"]
    return q.select(*keys, "mean_value").join(resid, keys).join(ect, keys).dropna().select(*keys, "resid", "ect")


@query("feature_left_merge", f"""WITH {QUARTERS}, o AS (SELECT entity, quarter_end + INTERVAL 5 HOUR AS stamp, last_value AS extra FROM q WHERE month(quarter_end) IN (3, 9))
SELECT q.entity, q.quarter_end, q.mean_value, o.extra FROM q LEFT JOIN o ON q.entity = o.entity AND q.quarter_end = CAST(o.stamp AS DATE)""")
def _(spark, sf_dir):
    q = quarters(spark, sf_dir)
    other = q.filter(F.month("quarter_end").isin(3, 9)).select("entity", F.expr("cast(quarter_end as timestamp_ntz) + interval 5 hours").alias("stamp"), F.col("last_value").alias("extra"))
    dated = other.select("entity", F.to_date("stamp").alias("quarter_end"), "extra")
    return q.join(dated, ["entity", "quarter_end"], "left").select("entity", "quarter_end", "mean_value", "extra")


@query("meeting_quarter_join", f"""WITH {MONTHS}, f AS (SELECT entity, year(ts)::VARCHAR || 'Q' || quarter(ts)::VARCHAR AS quarter, value FROM m QUALIFY row_number() OVER (PARTITION BY entity, year(ts), quarter(ts) ORDER BY ts) = 1)
SELECT o_orderkey, f.quarter, f.value FROM orders o JOIN f ON o.o_orderpriority = f.entity AND year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR = f.quarter WHERE o_orderstatus = 'P'""")
def _(spark, sf_dir):
    first = months(spark, sf_dir).withColumn("quarter", quarter_name(F.col("ts"))).groupBy("entity", "quarter").agg(F.min_by("value", "ts").alias("value"))
    meetings = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("entity"), quarter_name(F.col("o_orderdate").cast("date")).alias("quarter"))
    return meetings.join(first, ["entity", "quarter"]).select("o_orderkey", "quarter", "value")


@query("lagged_feature_join", f"""WITH {QUARTERS}, f AS (SELECT entity, quarter_end, mean_value, mean_value - lag(mean_value) OVER w AS diff FROM q WINDOW w AS (PARTITION BY entity ORDER BY quarter_end)),
lb AS (SELECT o_orderpriority AS entity, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS quarter_end, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT lb.entity, year(lb.quarter_end)::VARCHAR || 'Q' || quarter(lb.quarter_end)::VARCHAR AS quarter, n, f.mean_value, round(f.diff, 4) AS diff FROM lb JOIN f ON lb.entity = f.entity AND last_day(f.quarter_end + INTERVAL 3 MONTH) = lb.quarter_end WHERE f.mean_value IS NOT NULL AND diff IS NOT NULL""")
def _(spark, sf_dir):
    features = quarters(spark, sf_dir).withColumn("diff", F.round(ts.first_difference("mean_value"), 4))
    labels = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("entity"), quarter_name(F.col("o_orderdate").cast("date")).alias("quarter")).agg(F.count("*").alias("n"))
    return ts.lagged_feature_join(labels, features, ["mean_value", "diff"])


@query("expanding_history_join", f"""WITH {MONTHS} SELECT a.entity, a.ts, count(b.ts)::BIGINT AS n, sum(b.n)::BIGINT AS total, sum(b.n * b.n)::BIGINT AS squares FROM m a JOIN m b ON a.entity = b.entity AND b.ts < a.ts GROUP BY 1, 2""")
def _(spark, sf_dir):
    return ts.expanding_sums(months(spark, sf_dir).select("entity", "ts", F.col("n").alias("x")), "entity", "ts", {"total": F.col("x"), "squares": F.col("x") * F.col("x")})


@query("context_index_from_labels", f"""WITH {LABELS}, mc AS (SELECT day, sum(meetings)::BIGINT AS n FROM lab WHERE entity < 3 GROUP BY 1)
SELECT lab.entity, lab.day, lab.actual_class || ' on ' || lab.day || ': ' || coalesce(mc.n::VARCHAR, 'unknown') || ' events' AS text FROM lab LEFT JOIN mc ON lab.day = mc.day""")
def _(spark, sf_dir):
    labels = day_labels(spark, sf_dir)
    macro = labels.filter("entity < 3").groupBy("day").agg(F.sum("meetings").alias("n"))
    text = F.format_string("%s on %s: %s events", "actual_class", F.col("day").cast("string"), F.coalesce(F.col("n").cast("string"), F.lit("unknown")))
    return labels.join(macro, "day", "left").select("entity", "day", text.alias("text"))
