"""Traces built from the lines: an order is a trace, a line a proposal, flags are clusters."""

from __future__ import annotations

from pyspark.sql import functions as F


from quarterlight.functions import registered
from quarterlight.operators import metrics, traces
from quarterlight.queries.registry import query, table

PR = """pr AS (SELECT l_orderkey AS trace, l_linenumber AS round, 'role' || (l_linenumber % 3)::VARCHAR AS role, max(l_returnflag) AS cluster, max(l_discount) / 0.13::DOUBLE AS hike, max(l_tax) / 0.11::DOUBLE AS ease, max(l_quantity) / 53 AS press, max(l_quantity) / 97 AS payoff, CAST(max(l_shipdate) AS DATE) AS date FROM lineitem GROUP BY 1, 2)"""


def proposals(spark, sf_dir):
    """One proposal for each order and line number, which lines may share."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("round")).agg(
        F.max("l_returnflag").alias("cluster"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q"), F.max("l_shipdate").cast("date").alias("date")
    )
    role = F.concat(F.lit("role"), (F.col("round") % 3).cast("string"))
    return lines.select("trace", "round", role.alias("role"), "cluster", (F.col("d") / 0.13).alias("hike"), (F.col("t") / 0.11).alias("ease"), (F.col("q") / 53).alias("press"), (F.col("q") / 97).alias("payoff"), "date")


@query("latest_per_role", f"WITH {PR} SELECT trace, role, max(round) AS round, arg_max(cluster, round) AS cluster FROM pr GROUP BY 1, 2")
def _(spark, sf_dir):
    return traces.latest_per_role(proposals(spark, sf_dir), ["trace", "role"], ["round"]).select("trace", "role", "round", "cluster")


@query("evidence_top_roles", f"WITH {PR} SELECT trace, string_agg(role || ' pays ' || format('{{:.2f}}', payoff), '; ' ORDER BY k) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY payoff DESC, round) AS k FROM pr) WHERE k <= 3 GROUP BY 1")
def _(spark, sf_dir):
    out = traces.top_roles(proposals(spark, sf_dir), ["trace"], "payoff", F.format_string("%s pays %.2f", "role", "payoff"), ties=["round"])
    return out.select("trace", F.array_join("lines", "; ").alias("lines"))


@query("persona_consistency", f"""WITH {PR}, p AS (SELECT role, avg(hike) AS ph, avg(press) AS pp FROM pr GROUP BY 1), la AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY trace, role ORDER BY round DESC) = 1),
d AS (SELECT trace, avg((abs(hike - round(ph, 4)) + abs(press - round(pp, 4))) / 2) AS d FROM la JOIN p ON la.role = p.role GROUP BY 1) SELECT trace, round(d, 6) AS distance, round(greatest(0.0, 1 - d / 0.3), 6)::DOUBLE AS score FROM d""")
def _(spark, sf_dir):
    pr = proposals(spark, sf_dir)
    priors = pr.groupBy("role").agg(F.round(F.avg("hike"), 4).alias("prior_hike"), F.round(F.avg("press"), 4).alias("prior_press"))
    out = traces.persona_consistency(traces.latest_per_role(pr, ["trace", "role"], ["round"]), priors, ["trace"], "role", ["hike", "press"])
    return out.select("trace", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("convergence_streak", f"""WITH {PR}, o AS (SELECT *, (press < 0.6 AND payoff < 0.4) AS ok FROM pr), g AS (SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY trace ORDER BY round) AS g FROM o), s AS (SELECT trace, g, count_if(ok) AS n, count(*) AS r FROM g GROUP BY 1, 2)
SELECT trace, sum(r)::BIGINT AS rounds, max(n)::BIGINT AS best_streak, max(n) >= 2 AS converged FROM s GROUP BY 1""")
def _(spark, sf_dir):
    return traces.convergence_streak(proposals(spark, sf_dir), ["trace"], "round", F.col("press"), F.col("payoff"), 0.6, 0.4, 2)


CL = f"""{PR}, cl AS (SELECT trace, cluster, round(sum(greatest(0.05, payoff) * hike) / sum(greatest(0.05, payoff)) + 3.1e-8, 6) AS hike, round(sum(greatest(0.05, payoff) * ease) / sum(greatest(0.05, payoff)) + 3.1e-8, 6) AS ease, round(sum(greatest(0.05, payoff) * press) / sum(greatest(0.05, payoff)) + 3.1e-8, 6) AS press FROM pr GROUP BY 1, 2)"""


def clusters(spark, sf_dir):
    out = traces.weighted_strategy(proposals(spark, sf_dir), ["trace", "cluster"], "payoff", ["hike", "ease", "press"])
    return out.select("trace", "cluster", *[F.round(F.col(c) + 3.1e-8, 6).alias(c) for c in ("hike", "ease", "press")], F.round("dispersion", 6).alias("dispersion"))


@query("payoff_weighted_strategy", f"WITH {CL} SELECT cl.*, round(d, 6) AS dispersion FROM cl JOIN (SELECT pr.trace, pr.cluster, max(greatest(abs(pr.hike - c.h), abs(pr.ease - c.e), abs(pr.press - c.p))) AS d FROM pr JOIN (SELECT trace, cluster, sum(greatest(0.05, payoff) * hike) / sum(greatest(0.05, payoff)) AS h, sum(greatest(0.05, payoff) * ease) / sum(greatest(0.05, payoff)) AS e, sum(greatest(0.05, payoff) * press) / sum(greatest(0.05, payoff)) AS p FROM pr GROUP BY 1, 2) c ON pr.trace = c.trace AND pr.cluster = c.cluster GROUP BY 1, 2) x ON cl.trace = x.trace AND cl.cluster = x.cluster")
def _(spark, sf_dir):
    return clusters(spark, sf_dir)


@query("cross_quarter_memory", f"WITH {CL}, w AS (SELECT trace, cluster, list(trace) OVER (PARTITION BY cluster ORDER BY trace ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM cl) SELECT trace, cluster, coalesce(array_to_string(list_reverse(m), ','), '') AS memory FROM w")
def _(spark, sf_dir):
    out = traces.recent_memory(clusters(spark, sf_dir), "cluster", ["trace"], ["trace"])
    return out.select("trace", "cluster", F.array_join(F.transform("memory", lambda x: x["trace"].cast("string")), ",").alias("memory"))


@query("external_shocks", f"""WITH {CL}, s AS (SELECT trace, max(press) AS pressure, coalesce(max(CASE WHEN cluster = 'R' THEN press END), 0) AS returned, coalesce(max(CASE WHEN cluster = 'A' THEN press END), 0) AS accepted FROM cl GROUP BY 1)
SELECT trace, unnest(['pressure', 'returned', 'accepted', 'energy', 'trade']) AS channel, unnest([pressure, returned, accepted, greatest(0.2, pressure * 0.8), greatest(0.1, pressure * 0.5)]::DOUBLE[]) AS value FROM s""")
def _(spark, sf_dir):
    return traces.external_shocks(clusters(spark, sf_dir), ["trace"], "cluster", "press", {"returned": "R", "accepted": "A"}, {"energy": (0.2, 0.8), "trade": (0.1, 0.5)}).withColumn("value", F.col("value"))


@query("payoff_source_counts", f"WITH {PR} SELECT cluster, CASE WHEN payoff >= 0.3 THEN 'judge' ELSE 'fallback' END AS source, count(*)::BIGINT AS n FROM pr GROUP BY 1, 2")
def _(spark, sf_dir):
    source = F.when(F.col("payoff") >= 0.3, "judge").otherwise("fallback")
    return proposals(spark, sf_dir).groupBy("cluster", source.alias("source")).agg(F.count("*").alias("n"))


DELTAS = f"""{CL}, fa AS (SELECT trace, cluster, unnest(['hike', 'ease', 'press']) AS field, unnest([hike, ease, press]) AS v FROM (SELECT trace, cluster, CASE WHEN trace % 5 > 0 THEN hike END AS hike, CASE WHEN trace % 5 > 0 THEN ease END AS ease, CASE WHEN trace % 5 > 0 THEN press END AS press FROM cl)),
cf AS (SELECT trace, cluster, unnest(['hike', 'ease', 'press']) AS field, unnest([round(hike + 0.1, 6), ease, round(press + (CASE WHEN trace % 2 = 0 THEN 0.2 ELSE -0.05 END), 6)]::DOUBLE[]) AS v FROM (SELECT trace, cluster, CASE WHEN trace % 7 > 0 THEN hike END AS hike, CASE WHEN trace % 7 > 0 THEN ease END AS ease, CASE WHEN trace % 7 > 0 THEN press END AS press FROM cl)),
de AS (SELECT coalesce(fa.trace, cf.trace) AS trace, coalesce(fa.cluster, cf.cluster) AS cluster, coalesce(fa.field, cf.field) AS field, fa.v AS factual, cf.v AS counterfactual, coalesce(cf.v, 0) - coalesce(fa.v, 0) AS delta
 FROM fa FULL JOIN cf ON fa.trace = cf.trace AND fa.cluster = cf.cluster AND fa.field = cf.field WHERE abs(coalesce(cf.v, 0) - coalesce(fa.v, 0)) > 1e-6)"""


def deltas(spark, sf_dir):
    cl = clusters(spark, sf_dir)
    given = lambda n: {c: F.when(F.col("trace") % n > 0, F.col(c)) for c in ("hike", "ease", "press")}
    changed = cl.withColumns(given(7)).withColumns({"hike": F.round(F.col("hike") + 0.1, 6), "press": F.round(F.col("press") + F.when(F.col("trace") % 2 == 0, 0.2).otherwise(-0.05), 6)})
    return traces.run_deltas(cl.withColumns(given(5)), changed, ["trace", "cluster"], ["hike", "ease", "press"])


@query("factual_counterfactual_join", f"WITH {DELTAS} SELECT trace, cluster, field, factual, counterfactual, round(delta, 6) AS delta FROM de")
def _(spark, sf_dir):
    return deltas(spark, sf_dir).withColumn("delta", F.round("delta", 6))


@query("top_shifts", f"WITH {DELTAS} SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY round(abs(delta), 9) DESC, cluster || field)::INTEGER AS place, cluster, field FROM de QUALIFY place <= 5")
def _(spark, sf_dir):
    d = deltas(spark, sf_dir).withColumns({"delta": F.round("delta", 9), "_field": F.col("field"), "field": F.concat("cluster", "field")})
    return traces.top_shifts(d, ["trace"], 5).select("trace", "place", "cluster", F.col("_field").alias("field"))


@query("p5_impact", f"""WITH {DELTAS}, s AS (SELECT trace, cluster, round(sum(abs(delta)), 6) AS shift, round(sum(CASE WHEN field = 'hike' THEN delta WHEN field = 'ease' THEN -delta ELSE 0 END), 6) AS hawkish, round(sum(CASE WHEN field = 'press' THEN delta ELSE 0 END), 6) AS external, arg_max(field, (round(abs(delta), 9), field)) AS top_field FROM de GROUP BY 1, 2)
SELECT trace, cluster, round(shift, 6) AS shift, top_field, CASE WHEN shift < 0.03 THEN 'little strategic change' WHEN abs(external) >= greatest(abs(hawkish), 0.05) THEN CASE WHEN external > 0 THEN 'external-pressure shock' ELSE 'external-pressure easing' END
 WHEN hawkish > 0.05 THEN 'hawkish policy pressure' WHEN hawkish < -0.05 THEN 'dovish or liquidity-support pressure' ELSE 'mixed strategic repositioning' END AS label FROM s""")
def _(spark, sf_dir):
    out = traces.impact(deltas(spark, sf_dir), ["trace", "cluster"], ["hike"], ["ease"], ["press"])
    return out.select("trace", "cluster", F.round("shift", 6).alias("shift"), "top_field", "label")


@query("evidence_diff", f"WITH {PR}, a AS (SELECT trace, list(DISTINCT role || cluster) FILTER (round <= 3) AS a, list(DISTINCT role || cluster) FILTER (round >= 2) AS b FROM pr GROUP BY 1) SELECT trace, coalesce(array_to_string(list_sort(list_filter(b, lambda x: NOT coalesce(list_contains(a, x), false))), ','), '') AS added, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT coalesce(list_contains(b, x), false))), ','), '') AS removed FROM a")
def _(spark, sf_dir):
    line = F.concat("role", "cluster")
    runs = proposals(spark, sf_dir).groupBy("trace").agg(F.collect_set(F.when(F.col("round") <= 3, line)).alias("a"), F.collect_set(F.when(F.col("round") >= 2, line)).alias("b"))
    d = traces.evidence_diff(F.col("a"), F.col("b"))
    return runs.select("trace", d.alias("d")).select("trace", F.array_join("d.added", ",").alias("added"), F.array_join("d.removed", ",").alias("removed"))


@query("mapping_diff", f"WITH {CL}, b AS (SELECT trace, cluster AS name, hike AS before FROM cl), a AS (SELECT trace, cluster AS name, CASE WHEN trace % 4 = 0 AND cluster = 'N' THEN NULL WHEN trace % 3 = 0 THEN round(hike + 0.1, 6) ELSE hike END AS after FROM cl) SELECT coalesce(a.trace, b.trace) AS trace, coalesce(a.name, b.name) AS name, before, after FROM b FULL JOIN a ON a.trace = b.trace AND a.name = b.name WHERE before IS DISTINCT FROM after")
def _(spark, sf_dir):
    cl = clusters(spark, sf_dir)
    as_map = lambda df: df.groupBy("trace").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "hike"))).alias("m"))
    gone = (F.col("trace") % 4 == 0) & (F.col("cluster") == "N")
    changed = cl.withColumn("hike", F.when(gone, None).when(F.col("trace") % 3 == 0, F.round(F.col("hike") + 0.1, 6)).otherwise(F.col("hike")))
    return traces.mapping_diff(as_map(cl), as_map(changed), "trace", "m")


@query("apply_overrides", """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS inflation, l_tax * 50 AS growth, l_quantity / 10 AS rate FROM lineitem), s(scenario, o_inflation, o_rate) AS (VALUES ('hot', 9.0::DOUBLE, NULL::DOUBLE), ('cut', NULL, 1.0), ('both', 4.0, 2.0)),
x AS (SELECT l_orderkey, l_linenumber, scenario, coalesce(o_inflation, inflation) AS inflation, growth, coalesce(o_rate, rate) AS rate, concat_ws(',', CASE WHEN o_inflation IS NOT NULL THEN 'inflation' END, CASE WHEN o_rate IS NOT NULL THEN 'rate' END) AS overridden FROM b, s),
g AS (SELECT *, 2.5::DOUBLE + inflation + 1.5::DOUBLE * (inflation - 2) + 0.5::DOUBLE * (growth - 2) - rate AS gap FROM x) SELECT l_orderkey, l_linenumber, scenario, overridden, round(gap, 4) AS gap, CASE WHEN round(gap, 6) > 1 THEN 'too_loose' WHEN round(gap, 6) < -1 THEN 'too_tight' ELSE 'near_rule' END AS signal FROM g""")
def _(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("inflation"), (F.col("l_tax") * 50).alias("growth"), (F.col("l_quantity") / 10).alias("rate"))
    s = spark.createDataFrame([("hot", 9.0, None), ("cut", None, 1.0), ("both", 4.0, 2.0)], "scenario string, o_inflation double, o_rate double")
    out = traces.apply_overrides(b, s, ["inflation", "rate"], "rate", "inflation", "growth", "gap", "signal")
    return out.select("l_orderkey", "l_linenumber", "scenario", F.array_join("overridden", ",").alias("overridden"), F.round("gap", 4).alias("gap"), "signal")


RULES = {"no move": "hike < 0.1 AND ease < 0.1", "both ways": "hike > 0.5 AND ease > 0.5", "low payoff": "payoff < 0.1"}


@query("critic_rules", f"WITH {PR} SELECT trace, round, concat_ws(',', {', '.join(f'''CASE WHEN {t} THEN '{n}' END''' for n, t in RULES.items())}) AS issues, round(1 - 0.2::DOUBLE * ({' + '.join(f'({t})::INTEGER' for t in RULES.values())}), 6) AS feasibility FROM pr")
def _(spark, sf_dir):
    out = traces.critic(proposals(spark, sf_dir), {n: F.expr(t) for n, t in RULES.items()})
    return out.select("trace", "round", F.array_join("issues", ",").alias("issues"), "feasibility")


@query("evidence_chain", f"""WITH {PR} SELECT trace, round, concat_ws(',', CASE WHEN hike > 0.6 THEN 'ect' END, CASE WHEN ease > 0.5 THEN 'easing' END, CASE WHEN press > 0.8 THEN 'shock' END) AS layers, ((hike > 0.6)::INTEGER + (press > 0.8)::INTEGER)::INTEGER AS n_hawkish, (ease > 0.5)::INTEGER AS n_dovish,
round(CASE WHEN hike > 0.6 THEN least(1, hike / 1.5) ELSE 0 END + CASE WHEN ease > 0.5 THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN press > 0.8 THEN 0.5::DOUBLE ELSE 0 END, 5) AS confidence FROM pr""")
def _(spark, sf_dir):
    layers = [("ect", F.col("hike") > 0.6, "hawkish", F.least(F.lit(1.0), F.col("hike") / 1.5)), ("easing", F.col("ease") > 0.5, "dovish", F.lit(0.6)), ("shock", F.col("press") > 0.8, "hawkish", F.lit(0.5))]
    out = traces.evidence_chain(proposals(spark, sf_dir), layers)
    total = F.aggregate("evidence", F.lit(0.0), lambda a, x: a + x["confidence"])
    return out.select("trace", "round", F.array_join(F.transform("evidence", lambda x: x["layer"]), ",").alias("layers"), "n_hawkish", "n_dovish", F.round(total, 5).alias("confidence"))


TR = f"{PR}, tr AS (SELECT trace, count(*)::INTEGER AS rounds, bool_or(hike > 0.8) AS converged, round(avg(press), 6) AS distance, round(avg(payoff), 6) AS gain, (trace % 4)::INTEGER AS bucket FROM pr GROUP BY 1)"


def trace_rows(spark, sf_dir):
    return proposals(spark, sf_dir).groupBy("trace").agg(F.count("*").cast("int").alias("rounds"), F.bool_or(F.col("hike") > 0.8).alias("converged"), F.round(F.avg("press"), 6).alias("distance"), F.round(F.avg("payoff"), 6).alias("gain")).withColumn("bucket", (F.col("trace") % 4).cast("int"))


@query("convergence_metrics", f"WITH {TR} SELECT bucket, count(*)::BIGINT AS n, round(avg(converged::INTEGER), 4) AS convergence_rate, round(avg(rounds), 4) AS mean_rounds, round(median(rounds), 4) AS median_rounds, round(avg(distance), 4) AS mean_distance, round(avg(gain), 4) AS mean_gain FROM tr GROUP BY 1")
def _(spark, sf_dir):
    return traces.convergence_metrics(trace_rows(spark, sf_dir), ["bucket"])


@query("rounds_histogram", f"WITH {TR} SELECT rounds, count(*)::BIGINT AS n FROM tr GROUP BY 1")
def _(spark, sf_dir):
    return trace_rows(spark, sf_dir).groupBy("rounds").agg(F.count("*").alias("n"))


@query("equilibrium_metrics", f"WITH {TR} SELECT bucket, round(count_if(rounds > 2) / count(*), 4) AS checked_rate, round(count_if(rounds > 2 AND rounds % 2 = 0) / count_if(rounds > 2), 4) AS llm_rate, round(count_if(rounds > 2 AND converged) / count_if(rounds > 2), 4) AS accepted_rate, round(avg(CASE WHEN rounds > 2 THEN gain END), 4) AS mean_gain FROM tr GROUP BY 1")
def _(spark, sf_dir):
    check = F.when(F.col("rounds") > 2, F.struct(F.when(F.col("rounds") % 2 == 0, "llm").otherwise("rule").alias("source"), F.col("converged").alias("accepted"), "gain"))
    return traces.equilibrium_metrics(trace_rows(spark, sf_dir).withColumn("check", check), "check", ["bucket"])


JS = """js AS (SELECT o_orderkey, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS cutoff, CAST(o_orderdate AS DATE) AS od, CAST(l_shipdate AS DATE) AS sd FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS l_shipdate FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON o_orderkey = l_orderkey)"""


def trace_json(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.date_format(F.max("l_shipdate"), "yyyy/MM/dd").alias("sd"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"), F.concat(F.lit("due by "), "sd").alias("claim"))
    record = F.to_json(F.struct(F.array(item).alias("evidence_chain"), F.struct(F.struct(F.lit("2026-07-08").alias("research_cutoff")).alias("usa")).alias("personas_used")))
    return o.select("o_orderkey", record.alias("js"), F.last_day(F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 2)).alias("cutoff"))


@query("json_walk_dates", f"WITH {JS} SELECT o_orderkey, '$.evidence_chain[0].published_at' AS path, od AS date FROM js UNION ALL SELECT o_orderkey, '$.evidence_chain[0].claim', sd FROM js")
def _(spark, sf_dir):
    return traces.json_dates(trace_json(spark, sf_dir), "o_orderkey", "js")


@query("json_walk_lateral", f"WITH {JS} SELECT o_orderkey, '$.evidence_chain[0].published_at' AS path, od::VARCHAR AS value FROM js")
def _(spark, sf_dir):
    registered.register(spark)
    return spark.sql("SELECT o_orderkey, w.path, w.value FROM {records}, LATERAL json_walk(js, 'string') w WHERE w.path LIKE '%.published_at'", records=trace_json(spark, sf_dir))


@query("leakage_scan", f"WITH {JS} SELECT o_orderkey, 2::BIGINT AS mentions, (sd > cutoff)::BIGINT AS future, sd > cutoff AS leaked, CASE WHEN sd > cutoff THEN '$.evidence_chain[0].claim' ELSE '' END AS examples FROM js")
def _(spark, sf_dir):
    return traces.leakage_scan(trace_json(spark, sf_dir), "o_orderkey", "js", "cutoff").withColumn("examples", F.array_join("examples", ","))


@query("extract_first_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE user_id END::BIGINT AS a FROM events")
def _(spark, sf_dir):
    k = F.col("event_id") % 4
    body = F.concat(F.lit('answer: {"note": "a } and \\"{", "a": '), F.col("user_id").cast("string"), F.lit('} then {"a": 0}'))
    said = F.when(k == 3, F.lit("{broken")).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(traces.first_json(said), "$.a").try_cast("bigint").alias("a"))


@query("semantic_signal_summary", f"WITH {PR} SELECT cluster, round(avg(hike), 4) AS mean_score, count_if(payoff >= 0.3)::BIGINT AS n_model, count_if(payoff < 0.3)::BIGINT AS n_rule FROM pr GROUP BY 1")
def _(spark, sf_dir):
    return proposals(spark, sf_dir).groupBy("cluster").agg(F.round(F.avg("hike"), 4).alias("mean_score"), F.count_if(F.col("payoff") >= 0.3).alias("n_model"), F.count_if(F.col("payoff") < 0.3).alias("n_rule"))


@query("economics_penalty", f"WITH {PR}, d AS (SELECT *, press - lag(press) OVER (PARTITION BY trace ORDER BY round) AS m FROM pr) SELECT trace, round(avg(abs(press - ease)) + coalesce(avg(greatest(0, -(hike - 0.5) * m)), 0), 4) AS penalty FROM d GROUP BY 1")
def _(spark, sf_dir):
    return metrics.economics_penalty(proposals(spark, sf_dir).withColumn("ect", F.col("hike") - 0.5), "trace", "round", "press", "ease", "ect")


@query("game_features", f"""WITH {PR} SELECT trace, count(*)::INTEGER AS n_roles, round(max(press), 6) AS top_shock, count_if(press > 0.8)::INTEGER AS n_shocks, round(arg_max(hike, round), 6) AS last_hike FROM pr GROUP BY 1""")
def _(spark, sf_dir):
    packed = proposals(spark, sf_dir).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("round", "hike", "press"))).alias("p"))
    parsed = packed.select("trace", F.from_json(F.to_json("p"), "array<struct<round:int,hike:double,press:double>>").alias("p"))
    return parsed.select("trace", F.size("p").alias("n_roles"), F.round(F.array_max(F.transform("p", lambda x: x["press"])), 6).alias("top_shock"), F.size(F.filter("p", lambda x: x["press"] > 0.8)).alias("n_shocks"), F.round(F.element_at("p", -1)["hike"], 6).alias("last_hike"))
