"""Training-corpus operators over conversations, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlight.functions import registered
from quarterlight.functions.dates import quarter_end, quarter_name
from quarterlight.functions.rules import argmax_class
from quarterlight.operators import corpus, documents
from quarterlight.queries.registry import query, table


@query("union_training_sets", "SELECT 'a' AS source_file, conv_id, turn, role, NULL AS extra FROM conversations WHERE turn < 2 UNION ALL SELECT 'b', conv_id, turn, NULL, text FROM conversations WHERE turn >= 2")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    one, two = c.filter("turn < 2").select("conv_id", "turn", "role"), c.filter("turn >= 2").select("conv_id", "turn", F.col("text").alias("extra"))
    return corpus.union_training_sets({"a": one, "b": two}).select("source_file", "conv_id", "turn", "role", "extra")


TE = """te AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + ((o_orderkey % 30) * 300)::INTEGER AS day, o_orderkey % 5 AS k FROM orders),
ev AS (SELECT o_orderkey, CASE WHEN k IN (0, 2) THEN day WHEN k IN (1, 3) THEN CAST(date_trunc('quarter', day) AS DATE) END AS date, CASE k WHEN 0 THEN 'metadata.as_of_date' WHEN 1 THEN 'metadata.quarter' WHEN 2 THEN 'messages[1].date' WHEN 3 THEN 'messages[1].quarter' END AS source FROM te),
sp AS (SELECT *, CASE WHEN date IS NULL THEN 'unassigned' WHEN date <= DATE '2004-12-31' THEN 'train' WHEN date <= DATE '2010-12-31' THEN 'val' WHEN date <= DATE '2030-12-31' THEN 'test' ELSE 'unassigned' END AS split FROM ev)"""
WINDOWS = (("train", "1900-01-01", "2004-12-31"), ("val", "2005-01-01", "2010-12-31"), ("test", "2011-01-01", "2030-12-31"))


def dated(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    day = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30 * 300).cast("int"))
    quarter = quarter_name(day)
    metadata = F.when(k == 0, F.create_map(F.lit("as_of_date"), day.cast("string"))).when(k == 1, F.create_map(F.lit("quarter"), quarter)).otherwise(F.create_map(F.lit("other"), F.lit("2000-01-01")))
    body = F.when(k == 2, F.to_json(F.struct(day.cast("string").alias("date")))).when(k == 3, F.to_json(F.struct(quarter.alias("quarter")))).otherwise("plain text")
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))
    return table(spark, sf_dir, "orders").select("o_orderkey", corpus.temporal_evidence(metadata, messages).alias("e")).select("o_orderkey", "e.date", "e.source").withColumn("split", corpus.temporal_split(F.col("date"), WINDOWS))


@query("temporal_evidence", f"WITH {TE} SELECT o_orderkey, date, source FROM ev")
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("o_orderkey", "date", "source")


@query("temporal_split_jsonl", f"WITH {TE} SELECT split, o_orderkey FROM sp")
def _(spark, sf_dir):
    from quarterlight.scratch import scratch_path

    path = scratch_path(spark, "split")
    dated(spark, sf_dir).select("o_orderkey", "split").write.partitionBy("split").json(path)
    return spark.read.schema("o_orderkey long, split string").json(path).select("split", "o_orderkey")


def stats(spark, sf_dir):
    return corpus.split_stats(dated(spark, sf_dir).filter("split <> 'unassigned'"), "split", "date", "source")


@query("split_stats", f"WITH {TE} SELECT split, count(*)::BIGINT AS rows, min(date) AS first, max(date) AS last, count_if(source = 'metadata.as_of_date')::BIGINT AS by_metadata FROM sp WHERE split <> 'unassigned' GROUP BY 1")
def _(spark, sf_dir):
    return stats(spark, sf_dir).select("split", "rows", "first", "last", F.col("sources")["metadata.as_of_date"].alias("by_metadata"))


@query("split_leakage_check", f"WITH {TE}, s AS (SELECT split, count(*) AS n, min(date) AS a, max(date) AS b FROM sp WHERE split <> 'unassigned' GROUP BY 1) SELECT 'val' AS split, 'outside its window' AS issue FROM s WHERE split = 'val' AND b > DATE '2009-12-31'")
def _(spark, sf_dir):
    shorter = (WINDOWS[0], ("val", "2005-01-01", "2009-12-31"), WINDOWS[2])
    return corpus.split_check(stats(spark, sf_dir), "split", shorter)


@query("dapt_corpus", r"SELECT doc_id, md5(substr(replace(CASE WHEN doc_id % 10 = 0 THEN source ELSE text END, chr(13) || chr(10), chr(10)), 1, 6000)) AS text FROM documents")
def _(spark, sf_dir):
    shown = F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(corpus.dapt_text(shown, F.col("source")).cast("binary")).alias("text"))


CHAT = """SELECT event_id, 'role_strategy' AS task, '{"event":"' || event_type || '"}' AS user_text, CASE event_type WHEN 'purchase' THEN 'tighten' WHEN 'error' THEN 'ease' ELSE 'describe' END AS answer FROM events"""


@query("chat_examples", CHAT)
def _(spark, sf_dir):
    answer = F.when(F.col("event_type") == "purchase", "tighten").when(F.col("event_type") == "error", "ease").otherwise("describe")
    rows = corpus.chat_rows(table(spark, sf_dir, "events"), "role_strategy", F.lit("Answer with a strategy."), F.to_json(F.struct(F.col("event_type").alias("event"))), answer, {"event_id": F.col("event_id")})
    return rows.select(F.col("metadata")["event_id"].cast("long").alias("event_id"), "task", F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("answer"))


@query("distillation_rows", """WITH p AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS c, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, c, round(avg(q), 4) AS target FROM p GROUP BY 1, 2)
SELECT p.l_orderkey, p.l_linenumber, p.c AS cluster, t.target FROM p JOIN t ON p.l_orderkey = t.l_orderkey AND p.c = t.c""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("cluster"), F.max("l_quantity").alias("q"))
    nested = p.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "cluster")).alias("proposals"))
    targets = p.groupBy("l_orderkey", "cluster").agg(F.round(F.avg("q"), 4).alias("target"))
    rows = nested.select("l_orderkey", F.explode("proposals").alias("x")).select("l_orderkey", "x.*").join(targets, ["l_orderkey", "cluster"])
    chat = corpus.chat_rows(rows, "distill", F.lit("Give the cluster's strategy."), F.col("cluster"), F.to_json(F.struct("target")), {"order": F.col("l_orderkey"), "line": F.col("l_linenumber")})
    return chat.select(F.col("metadata")["order"].cast("long").alias("l_orderkey"), F.col("metadata")["line"].cast("int").alias("l_linenumber"), F.col("messages")[1]["content"].alias("cluster"), F.get_json_object(F.col("messages")[2]["content"], "$.target").cast("double").alias("target"))


@query("compact_sft", """WITH p AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2), e AS (SELECT l_orderkey, arg_min(l_linenumber, l_linenumber) AS ref FROM p WHERE d > 0.03 GROUP BY 1)
SELECT p.l_orderkey, l_linenumber, round(q / 7, 4) AS score, coalesce('line ' || ref, 'trace ' || p.l_orderkey) AS evidence FROM p LEFT JOIN e ON p.l_orderkey = e.l_orderkey""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    spoken = p.withColumn("content", F.to_json(F.create_map(F.lit("score"), F.col("q") / 7)))
    rounded = F.transform_values(F.from_json("content", "map<string,double>"), lambda _, v: F.round(v, 4))
    refs = p.filter("d > 0.03").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("ref"))
    evidence = F.coalesce(F.concat(F.lit("line "), F.col("ref").cast("string")), F.concat(F.lit("trace "), F.col("l_orderkey").cast("string")))
    return spoken.join(refs, "l_orderkey", "left").select("l_orderkey", "l_linenumber", rounded["score"].alias("score"), evidence.alias("evidence"))


@query("balanced_windows", """WITH p AS (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders),
w AS (SELECT DISTINCT y, CASE WHEN y <= 1998 THEN 'early' ELSE 'late' END AS win, round_even(i * (n - 1) / (CASE WHEN y <= 1998 THEN 9.0 ELSE 4.0 END)::DOUBLE, 0)::BIGINT AS p FROM p, (SELECT unnest(range(10)) AS i) WHERE y <= 1998 OR i < 5)
SELECT win AS "window", count(*)::BIGINT AS rows, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM p JOIN w ON p.y = w.y AND p.p = w.p GROUP BY 1""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    year = F.year("o_orderdate")
    parts = [documents.even_sample(o.filter(test), year, ["o_orderdate", "o_orderkey"], n).withColumn("window", F.lit(name)) for name, test, n in (("early", year <= 1998, 10), ("late", year > 1998, 5))]
    return parts[0].unionByName(parts[1]).groupBy("window").agg(F.count("*").alias("rows"), F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))


@query("corpus_row_checks", "SELECT 'late' AS name, 0::BIGINT AS rows, 'issue' AS severity UNION ALL SELECT 'odd', 0, 'warning'")
def _(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "conversations")
    return corpus.row_checks({"orders": o, "late": o.filter(F.year("o_orderdate") > 2100), "odd": c.filter("turn < 0"), "chat": c}, ["orders", "late", "chat"])


RW = """b AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS d, max(l_tax) AS t, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, (l_orderkey % 6)::INTEGER AS k, d * 10 AS h0, q / 53 AS o0, t * 7 AS c0 FROM b),
r AS (SELECT *, h0 / (h0 + o0 + c0) AS h, o0 / (h0 + o0 + c0) AS o, c0 / (h0 + o0 + c0) AS c, CASE WHEN l_linenumber % 4 = 0 THEN 'hike_25bp' WHEN l_linenumber % 4 = 1 THEN 'hold' WHEN l_linenumber % 4 = 2 THEN 'cut_25bp' END AS a FROM x),
p AS (SELECT *, CASE WHEN h >= o AND h >= c THEN 'hike_25bp' WHEN o >= c THEN 'hold' ELSE 'cut_25bp' END AS pr, greatest(h, o, c) AS mx FROM r),
s AS (SELECT l_orderkey, l_linenumber, k, o, pr, CASE WHEN k < 3 THEN 1.0 WHEN k = 3 THEN 0.0 ELSE -1.0 END::DOUBLE AS schema_valid, CASE k WHEN 5 THEN -1.0 WHEN 0 THEN 1.0 ELSE greatest(-1.0, -0.25 * k) END::DOUBLE AS no_future_leakage,
 CASE WHEN k = 5 THEN -1.0 WHEN k = 0 THEN -0.3 ELSE 1 / greatest(k, 1) END::DOUBLE AS evidence_traceable,
 CASE WHEN k = 5 THEN -1.0::DOUBLE WHEN a IS NULL THEN 0 ELSE round(greatest(-1, 1 - (pow(h - (a = 'hike_25bp')::INTEGER, 2) + pow(o - (a = 'hold')::INTEGER, 2) + pow(c - (a = 'cut_25bp')::INTEGER, 2))), 6) END AS fed_probability_calibrated,
 CASE WHEN k = 5 THEN -1.0::DOUBLE WHEN a IS NULL THEN 0 WHEN pr = a THEN round(mx, 6) WHEN mx >= 0.75 THEN -1 WHEN mx >= 0.6 THEN -0.6 ELSE -0.2 END AS overconfident_wrong_prediction,
 CASE WHEN k = 5 THEN -1.0::DOUBLE WHEN a IN ('hike_25bp', 'cut_25bp') THEN CASE WHEN pr = 'hold' AND o >= 0.6 THEN -0.8 WHEN pr = 'hold' AND o >= 0.5 THEN -0.5 WHEN o >= 0.75 THEN -1 WHEN o >= 0.6 AND greatest(h, c) < 0.25 THEN -0.6 ELSE greatest(-0.2, round(1 - o, 6)) END
  WHEN a = 'hold' THEN CASE WHEN o > 0.9 THEN 0.2 ELSE least(1, round(0.3::DOUBLE + o, 6)) END WHEN o >= 0.85 AND greatest(h, c) < 0.1 THEN -0.6 ELSE 0.3 END AS not_always_hold FROM p)"""
SIX = ["schema_valid", "no_future_leakage", "evidence_traceable", "fed_probability_calibrated", "overconfident_wrong_prediction", "not_always_hold"]


def rewarded(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q"))
    k, n = (F.col("l_orderkey") % 6).cast("int"), F.col("l_linenumber") % 4
    h, o, c = F.col("d") * 10, F.col("q") / 53, F.col("t") * 7
    item = lambda i: F.struct(F.when(i == 1, "s1").alias("source_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("date"))
    rows = b.withColumns({
        "k": k, "h": h / (h + o + c), "o": o / (h + o + c), "c": c / (h + o + c), "actual": F.when(n == 0, "hike_25bp").when(n == 1, "hold").when(n == 2, "cut_25bp"),
        "evidence": F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), item)), "rationale": F.lit(""), "rounds": F.lit(None).cast("int"), "converged": F.lit(False), "stable_rounds": F.lit(None).cast("int"),
        "regret": F.lit(None).cast("double"), "future_mentions": k, "complete": F.when(k < 5, k < 3), "numeric": k < 4, "in_range": F.lit(True), "missing": F.when(k == 3, 1).otherwise(5),
    })
    return corpus.reward_components(rows, "h", "o", "c", "actual").withColumn("predicted", argmax_class([F.col("h"), F.col("o"), F.col("c")]))


@query("reward_components", f"WITH {RW} SELECT l_orderkey, l_linenumber, {', '.join(f'round({n}, 6) AS {n}' for n in SIX)} FROM s")
def _(spark, sf_dir):
    return rewarded(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(n, 6).alias(n) for n in SIX])


@query("weighted_reward", f"WITH {RW} SELECT l_orderkey, l_linenumber, round((schema_valid + no_future_leakage + 0.8::DOUBLE * evidence_traceable + 1.2::DOUBLE * fed_probability_calibrated + overconfident_wrong_prediction + not_always_hold) / 6.0, 9) AS reward FROM s")
def _(spark, sf_dir):
    return rewarded(spark, sf_dir).select("l_orderkey", "l_linenumber", corpus.weighted_reward(SIX, digits=9).alias("reward"))


@query("reward_functions", f"WITH {RW} SELECT l_orderkey, l_linenumber, round(CASE WHEN k < 5 THEN fed_probability_calibrated END, 6) AS calibrated, round(CASE WHEN k < 5 THEN no_future_leakage END, 6) AS leakage, round(CASE WHEN k < 5 THEN (no_future_leakage + 1.2::DOUBLE * fed_probability_calibrated) / 2.2::DOUBLE END, 6) AS weighted FROM s")
def _(spark, sf_dir):
    registered.register(spark)
    return spark.sql(
        """WITH r AS (SELECT l_orderkey, l_linenumber, k, reward_probability_calibrated(h, o, c, actual) AS calibrated, reward_no_future_leakage(CAST(future_mentions AS INT)) AS leakage FROM {rows})
        SELECT l_orderkey, l_linenumber, round(if(k < 5, calibrated, NULL), 6) AS calibrated, round(if(k < 5, leakage, NULL), 6) AS leakage, round(if(k < 5, reward_weighted(map('fed_probability_calibrated', calibrated, 'no_future_leakage', leakage)), NULL), 6) AS weighted FROM r""",
        rows=rewarded(spark, sf_dir),
    )


@query("batch_hold_penalty", f"""WITH {RW}, g AS (SELECT l_orderkey, count_if(pr = 'hold') / count(*) AS sh, avg(o) AS m, count(*) AS n FROM s GROUP BY 1)
SELECT s.l_orderkey, l_linenumber, round(least(not_always_hold, CASE WHEN n < 2 THEN 1.0 WHEN sh >= 0.95 AND m >= 0.6 THEN -1.0 WHEN sh >= 0.85 AND m >= 0.55 THEN -0.6 WHEN sh >= 0.75 THEN -0.2 ELSE 1.0 END), 6)::DOUBLE AS score FROM s JOIN g ON s.l_orderkey = g.l_orderkey""")
def _(spark, sf_dir):
    out = corpus.batch_hold_penalty(rewarded(spark, sf_dir).withColumn("score", F.col("not_always_hold")), "l_orderkey", "o", "predicted", "score")
    return out.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


_long = " UNION ALL ".join(f"SELECT '{n}' AS component, {n} AS score FROM s" for n in SIX)


@query("reward_report", f"WITH {RW}, u AS ({_long}) SELECT component, round(avg(score), 4) AS mean, count_if(score < 0)::BIGINT AS negative, count_if(score < -0.5)::BIGINT AS lowest, count_if(score >= -0.5 AND score < 0)::BIGINT AS low, count_if(score >= 0 AND score < 0.5)::BIGINT AS high, count_if(score >= 0.5)::BIGINT AS highest FROM u GROUP BY 1")
def _(spark, sf_dir):
    return corpus.reward_report(rewarded(spark, sf_dir), SIX).withColumn("mean", F.round("mean", 4))


@query("role_consistency", """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_discount) / 0.11::DOUBLE AS h, max(l_tax) / 0.09::DOUBLE AS r, max(l_quantity) / 53 AS p FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(greatest(-1, 1 - 3 * greatest(0, 0.25::DOUBLE - h)), 6) WHEN 1 THEN round(greatest(-1, 1 - 3 * (greatest(0, h - 0.75::DOUBLE) + greatest(0, r - 0.45::DOUBLE))), 6) WHEN 2 THEN round(greatest(-1, 1 - 3 * greatest(0, p - 0.7::DOUBLE)), 6) ELSE 0 END::DOUBLE AS score FROM b""")
def _(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") / 0.11).alias("h"), (F.max("l_tax") / 0.09).alias("r"), (F.max("l_quantity") / 53).alias("p"))
    n = F.col("l_linenumber") % 4
    role = F.when(n == 0, "Fed hawk").when(n == 1, "DOVE two").when(n == 2, "euro bloc").otherwise("staff")
    score = corpus.role_consistency(role, {"hawkish_signal_prob": F.col("h"), "rate_hike_25bp_prob": F.col("r"), "trade_or_sanction_pressure_prob": F.col("p")})
    return b.select("l_orderkey", "l_linenumber", score.alias("score"))


@query("legacy_rewards", """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) / 53 AS a, max(l_discount) / 0.11::DOUBLE AS b FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, round(greatest(-1, 1 - 3 * abs(a - b)), 6) AS convergence, CASE WHEN a <= 1 AND b <= 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS schema FROM b""")
def _(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") / 53).alias("a"), (F.max("l_discount") / 0.11).alias("b"))
    return b.select("l_orderkey", "l_linenumber", F.round(F.greatest(F.lit(-1.0), 1 - 3 * F.abs(F.col("a") - F.col("b"))), 6).alias("convergence"), F.when((F.col("a") <= 1) & (F.col("b") <= 1), 1.0).otherwise(-1.0).alias("schema"))


@query("prediction_forecast_report", f"""WITH {RW}, v AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'hike_25bp' WHEN 1 THEN 'hold' WHEN 2 THEN 'cut_25bp' END AS a FROM s WHERE k < 5)
SELECT (SELECT count(*) FROM s WHERE k = 5)::BIGINT AS invalid, count(*)::BIGINT AS n, round(avg((pr = a)::INTEGER), 6) AS accuracy, round(avg(o), 5) AS mean_hold FROM v WHERE a IS NOT NULL""")
def _(spark, sf_dir):
    rows = rewarded(spark, sf_dir)
    valid = F.col("complete").isNotNull()
    labelled = valid & F.col("actual").isNotNull()
    return rows.agg(F.count_if(~valid).alias("invalid"), F.count_if(labelled).alias("n"), F.round(F.avg(F.when(labelled, (F.col("predicted") == F.col("actual")).cast("int"))), 6).alias("accuracy"), F.round(F.avg(F.when(labelled, F.col("o"))), 5).alias("mean_hold"))
