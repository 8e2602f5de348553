"""Labels, baselines and forecast metrics over the events: a purchase is a move up, an error one down, a day a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.functions import rules
from quarterlight.operators import fusion, labels, metrics
from quarterlight.queries.registry import query, table

MEETINGS = """
mt AS (SELECT event_id, ts, (user_id % 5)::BIGINT AS entity, CAST(ts AS DATE) AS day,
              CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS decision FROM events)
"""
LABELS = f"""{MEETINGS},
ag AS (SELECT entity, day, sum(decision)::INTEGER AS net, arg_max(decision, (ts, event_id)) FILTER (decision <> 0) AS last_move, count(*)::BIGINT AS meetings FROM mt GROUP BY 1, 2),
lb AS (SELECT entity, day, net, meetings, (CASE WHEN net <> 0 THEN sign(net) ELSE coalesce(last_move, 0) END)::INTEGER AS actual FROM ag),
lab AS (SELECT *, CASE WHEN actual > 0 THEN 'hike_25bp' WHEN actual < 0 THEN 'cut_25bp' ELSE 'hold' END AS actual_class FROM lb)
"""
EVALUATED = f"""{LABELS},
tr AS (SELECT *, (coalesce(count_if(actual_class = 'hike_25bp') OVER w, 0) + 1) / (count(*) OVER w + 3) AS p_hike_25bp, (coalesce(count_if(actual_class = 'hold') OVER w, 0) + 1) / (count(*) OVER w + 3) AS p_hold,
              (coalesce(count_if(actual_class = 'cut_25bp') OVER w, 0) + 1) / (count(*) OVER w + 3) AS p_cut_25bp
       FROM lab WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ps AS (SELECT *, CASE WHEN b = 'hike_25bp' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS p_hike_25bp, CASE WHEN b = 'hold' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS p_hold, CASE WHEN b = 'cut_25bp' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS p_cut_25bp
       FROM (SELECT *, lag(actual_class) OVER (PARTITION BY entity ORDER BY day) AS b FROM lab) WHERE b IS NOT NULL)
"""
ADD_PREDICTED = """*, CASE WHEN p_hike_25bp >= p_hold AND p_hike_25bp >= p_cut_25bp THEN 'hike_25bp' WHEN p_hold >= p_cut_25bp THEN 'hold' ELSE 'cut_25bp' END AS predicted_class"""
_SQ = lambda c: f"pow(p_{c} - (actual_class = '{c}')::INTEGER, 2)"
_CL = ("hike_25bp", "hold", "cut_25bp")
_mean = lambda xs: f"list_avg(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
_hit = lambda c: f"count_if(actual_class = '{c}' AND predicted_class = '{c}')"
_sup = lambda c: f"count_if(actual_class = '{c}')"
_prd = lambda c: f"count_if(predicted_class = '{c}')"
METRICS = f"""count(*)::BIGINT AS n, round(avg((actual_class = predicted_class)::INTEGER), 6) AS accuracy,
round({_mean([f"CASE WHEN {_sup(c)} > 0 THEN {_hit(c)} / {_sup(c)} END" for c in _CL])}, 6) AS balanced_accuracy,
round({_mean([f"CASE WHEN {_sup(c)} + {_prd(c)} > 0 THEN 2.0::DOUBLE * {_hit(c)} / ({_sup(c)} + {_prd(c)}) END" for c in _CL])}, 6) AS macro_f1,
round(({_hit('hike_25bp')} + {_hit('cut_25bp')}) / nullif({_sup('hike_25bp')} + {_sup('cut_25bp')}, 0), 6) AS non_hold_recall,
round({_prd('hold')} / count(*) * avg(p_hold), 6) AS hold_collapse_index,
round(avg({' + '.join(map(_SQ, _CL))}), 6) AS brier_score,
{', '.join(f'round(avg({_SQ(c)}), 6) AS brier_{c}' for c in _CL)},
round(avg(-ln(greatest(1e-12, least(1.0, CASE actual_class WHEN 'hike_25bp' THEN p_hike_25bp WHEN 'hold' THEN p_hold ELSE p_cut_25bp END)))), 6) AS log_loss,
round(greatest({', '.join(map(_sup, _CL))}) / count(*), 6) AS majority_accuracy"""


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("entity"), F.col("ts").cast("date").alias("day"), move.alias("decision"))


def day_labels(spark, sf_dir) -> DataFrame:
    return labels.period_labels(meetings(spark, sf_dir), ["entity", "day"], ["ts", "event_id"])


def trailing(spark, sf_dir) -> DataFrame:
    return labels.trailing_shares(day_labels(spark, sf_dir), "entity", "day")


def persistent(spark, sf_dir) -> DataFrame:
    return labels.persistence(day_labels(spark, sf_dir), "entity", "day")


PROBS = ["p_hike_25bp", "p_hold", "p_cut_25bp"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("quarter_label", f"WITH {LABELS} SELECT entity, day, net, meetings, actual, actual_class FROM lab")
def _(spark, sf_dir):
    return day_labels(spark, sf_dir)


@query("class_priors", f"""WITH {LABELS} SELECT entity, round(count_if(actual_class = 'hike_25bp') / count(*), 6) AS p_hike_25bp, round(count_if(actual_class = 'hold') / count(*), 6) AS p_hold,
round(count_if(actual_class = 'cut_25bp') / count(*), 6) AS p_cut_25bp FROM lab GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(labels.class_priors(day_labels(spark, sf_dir), ["entity"]), *PROBS)


@query("persistence_baseline", f"WITH {EVALUATED} SELECT entity, day, actual_class, p_hike_25bp, p_hold, p_cut_25bp FROM ps")
def _(spark, sf_dir):
    return persistent(spark, sf_dir).select("entity", "day", "actual_class", *[F.round(p, 6).alias(p) for p in PROBS])


@query("forecast_metrics", f"WITH {EVALUATED} SELECT {METRICS} FROM (SELECT {ADD_PREDICTED} FROM tr)")
def _(spark, sf_dir):
    return metrics.forecast_metrics(trailing(spark, sf_dir))


@query("classification_diagnostics", f"WITH {EVALUATED} SELECT entity, balanced_accuracy, macro_f1, non_hold_recall, hold_collapse_index FROM (SELECT entity, {METRICS} FROM (SELECT {ADD_PREDICTED} FROM ps) GROUP BY entity)")
def _(spark, sf_dir):
    return metrics.forecast_metrics(persistent(spark, sf_dir), ["entity"]).select("entity", "balanced_accuracy", "macro_f1", "non_hold_recall", "hold_collapse_index")


SPLIT = "CASE WHEN day <= DATE '2024-01-15' THEN 'train' WHEN day <= DATE '2024-01-22' THEN 'val' ELSE 'test' END"


@query("metrics_by_split", f"WITH {EVALUATED}, r AS (SELECT {ADD_PREDICTED}, {SPLIT} AS split FROM tr) SELECT 'overall' AS split, {METRICS} FROM r UNION ALL SELECT split, {METRICS} FROM r GROUP BY split")
def _(spark, sf_dir):
    split = F.when(F.col("day") <= "2024-01-15", "train").when(F.col("day") <= "2024-01-22", "val").otherwise("test")
    return metrics.metrics_by_split(trailing(spark, sf_dir).withColumn("split", split), "split")


@query("confusion_matrix", f"""WITH {EVALUATED}, r AS (SELECT {ADD_PREDICTED} FROM ps), c AS (SELECT unnest(['hike_25bp', 'hold', 'cut_25bp']) AS actual_class)
SELECT c.actual_class, coalesce(count_if(predicted_class = 'hike_25bp'), 0)::BIGINT AS hike_25bp, coalesce(count_if(predicted_class = 'hold'), 0)::BIGINT AS hold, coalesce(count_if(predicted_class = 'cut_25bp'), 0)::BIGINT AS cut_25bp FROM c LEFT JOIN r ON c.actual_class = r.actual_class GROUP BY 1""")
def _(spark, sf_dir):
    return metrics.confusion_matrix(persistent(spark, sf_dir))


BINS = f"""{EVALUATED}, r AS (SELECT {ADD_PREDICTED} FROM tr),
lo AS (SELECT 'hike_25bp' AS label, p_hike_25bp AS p, (actual_class = 'hike_25bp')::INTEGER AS hit FROM r UNION ALL SELECT 'hold', p_hold, (actual_class = 'hold')::INTEGER FROM r
  UNION ALL SELECT 'cut_25bp', p_cut_25bp, (actual_class = 'cut_25bp')::INTEGER FROM r UNION ALL SELECT 'top', greatest(p_hike_25bp, p_hold, p_cut_25bp), (actual_class = predicted_class)::INTEGER FROM r),
bi AS (SELECT label, least(9, floor(p * 10))::INTEGER AS bin, count(*) AS n, avg(p) AS mp, avg(hit) AS ra FROM lo GROUP BY 1, 2),
gr AS (SELECT unnest(['hike_25bp', 'hold', 'cut_25bp', 'top']) AS label, x.bin FROM (SELECT unnest(range(10))::INTEGER AS bin) x),
cb AS (SELECT gr.label, gr.bin, coalesce(n, 0)::BIGINT AS count, round(mp, 6) AS mean_p, round(ra, 6) AS rate, round(abs(mp - ra), 6) AS gap FROM gr LEFT JOIN bi ON gr.label = bi.label AND gr.bin = bi.bin)
"""


@query("calibration_bins", f"WITH {BINS} SELECT label, bin, count, mean_p, rate, gap FROM cb")
def _(spark, sf_dir):
    return metrics.calibration_bins(trailing(spark, sf_dir))


@query("calibration_error", f"WITH {BINS} SELECT label, round(sum(gap * count) / sum(count), 5) AS ece FROM cb GROUP BY 1")
def _(spark, sf_dir):
    return metrics.expected_calibration_error(metrics.calibration_bins(trailing(spark, sf_dir)))


STUDY = f"""{MEETINGS}, ix AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS i FROM mt),
st AS (SELECT b.i - a.i AS off, b.decision AS d FROM ix a JOIN ix b ON a.entity = b.entity AND b.i BETWEEN a.i - 4 AND a.i + 4 WHERE a.decision <> 0)
"""


@query("event_study", f'WITH {STUDY} SELECT off::INTEGER AS "offset", round(avg(d), 6) AS mean_decision, round(avg(abs(d)), 6) AS mean_size, count(*)::BIGINT AS n FROM st GROUP BY 1')
def _(spark, sf_dir):
    return metrics.event_study(meetings(spark, sf_dir), "entity", ["ts", "event_id"], "decision")


@query("event_offset_join", f"WITH {STUDY} SELECT CASE WHEN off < 0 THEN 'before' WHEN off > 0 THEN 'after' ELSE 'event' END AS side, count(*)::BIGINT AS n, sum(d)::BIGINT AS total FROM st GROUP BY 1")
def _(spark, sf_dir):
    ix = meetings(spark, sf_dir)
    study = metrics.event_study(ix, "entity", ["ts", "event_id"], "decision")
    side = F.when(F.col("offset") < 0, "before").when(F.col("offset") > 0, "after").otherwise("event")
    return study.groupBy(side.alias("side")).agg(F.sum("n").alias("n"), F.sum(F.round(F.col("mean_decision") * F.col("n"))).cast("long").alias("total"))


BOTH = f"""{EVALUATED}, un AS (SELECT 'trailing' AS model, entity, day, actual_class, p_hike_25bp, p_hold, p_cut_25bp FROM tr UNION ALL SELECT 'persistence', entity, day, actual_class, p_hike_25bp, p_hold, p_cut_25bp FROM ps)"""


def both(spark, sf_dir):
    pick = lambda df, m: df.select(F.lit(m).alias("model"), "entity", "day", "actual_class", *PROBS)
    return pick(trailing(spark, sf_dir), "trailing").unionByName(pick(persistent(spark, sf_dir), "persistence"))


@query("forecasting_comparison", f"WITH {BOTH} SELECT model, {METRICS} FROM (SELECT {ADD_PREDICTED} FROM un) WHERE day > DATE '2024-01-15' GROUP BY model")
def _(spark, sf_dir):
    return metrics.forecast_metrics(both(spark, sf_dir).filter(F.col("day") > "2024-01-15"), ["model"])


@query("baseline_report", f"""WITH {BOTH}, pr AS (SELECT count_if(actual_class = 'hike_25bp') / count(*) AS p_hike_25bp, count_if(actual_class = 'hold') / count(*) AS p_hold, count_if(actual_class = 'cut_25bp') / count(*) AS p_cut_25bp FROM lab WHERE day <= DATE '2024-01-15'),
al AS (SELECT 'priors' AS model, actual_class, pr.* FROM lab, pr WHERE day > DATE '2024-01-15' UNION ALL SELECT model, actual_class, p_hike_25bp, p_hold, p_cut_25bp FROM un WHERE model = 'persistence' AND day > DATE '2024-01-15')
SELECT model, {METRICS}, count_if(actual_class = 'hike_25bp')::BIGINT AS n_hike, count_if(actual_class = 'hold')::BIGINT AS n_hold, count_if(actual_class = 'cut_25bp')::BIGINT AS n_cut FROM (SELECT {ADD_PREDICTED} FROM al) GROUP BY model""")
def _(spark, sf_dir):
    known = day_labels(spark, sf_dir)
    priors = labels.class_priors(known.filter(F.col("day") <= "2024-01-15"))
    late = known.filter(F.col("day") > "2024-01-15")
    # one row of priors for all labels
    by_prior = late.crossJoin(F.broadcast(priors)).select(F.lit("priors").alias("model"), "actual_class", *PROBS)
    by_last = persistent(spark, sf_dir).filter(F.col("day") > "2024-01-15").select(F.lit("persistence").alias("model"), "actual_class", *PROBS)
    counts = [F.count_if(F.col("actual_class") == c).alias(f"n_{c.split('_')[0]}") for c in _CL]
    rows = metrics.with_prediction(by_prior.unionByName(by_last))
    return rows.groupBy("model").agg(*metrics.metric_columns(), *counts)


@query("quarter_mean_probs", f"WITH {BOTH} SELECT day, round(avg(p_hike_25bp), 6) AS p_hike_25bp, round(avg(p_hold), 6) AS p_hold, round(avg(p_cut_25bp), 6) AS p_cut_25bp, count(*)::BIGINT AS n FROM un GROUP BY 1")
def _(spark, sf_dir):
    return both(spark, sf_dir).groupBy("day").agg(*[F.round(F.avg(p), 6).alias(p) for p in PROBS], F.count("*").alias("n"))


@query("ensemble_average", f"WITH {BOTH} SELECT entity, day, round(avg(p_hike_25bp), 6) AS p_hike_25bp, round(avg(p_hold), 6) AS p_hold, round(avg(p_cut_25bp), 6) AS p_cut_25bp FROM un GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(fusion.ensemble_average(both(spark, sf_dir), ["entity", "day"], PROBS), *PROBS)


PAIRED = f"""{EVALUATED}, pa AS (SELECT tr.entity, tr.day, tr.actual_class, tr.p_hike_25bp AS a1, tr.p_hold AS a2, tr.p_cut_25bp AS a3, ps.p_hike_25bp AS b1, ps.p_hold AS b2, ps.p_cut_25bp AS b3 FROM tr JOIN ps ON tr.entity = ps.entity AND tr.day = ps.day),
ga AS (SELECT *, CASE WHEN round(abs(a1 - b1), 9) < 0.1 THEN 0.8 WHEN round(abs(a1 - b1), 9) < 0.2 THEN 0.55 ELSE 0.4 END::DOUBLE AS w FROM pa),
gf AS (SELECT entity, day, w, w * a1 + (1 - w) * b1 AS g1, w * a2 + (1 - w) * b2 AS g2, w * a3 + (1 - w) * b3 AS g3, a1, a2, a3, b1, b2, b3, actual_class FROM ga)
"""


def paired(spark, sf_dir):
    a = trailing(spark, sf_dir).select("entity", "day", "actual_class", *[F.col(p).alias(f"a{i}") for i, p in enumerate(PROBS, 1)])
    b = persistent(spark, sf_dir).select("entity", "day", *[F.col(p).alias(f"b{i}") for i, p in enumerate(PROBS, 1)])
    return a.join(b, ["entity", "day"])


@query("gated_fusion", f"WITH {PAIRED} SELECT entity, day, w AS weight, round(g1 / (g1 + g2 + g3), 6) AS p_hike_25bp, round(g2 / (g1 + g2 + g3), 6) AS p_hold, round(g3 / (g1 + g2 + g3), 6) AS p_cut_25bp FROM gf")
def _(spark, sf_dir):
    out = fusion.gated(paired(spark, sf_dir), ["a1", "a2", "a3"], ["b1", "b2", "b3"], PROBS)
    return rounded(out, *PROBS).select("entity", "day", "weight", *PROBS)


@query("final_fusion", f"WITH {PAIRED} SELECT entity, day, round((g1 + a1 + b1) / (g1 + g2 + g3 + a1 + a2 + a3 + b1 + b2 + b3), 6) AS p_hike_25bp, round((g2 + a2 + b2) / (g1 + g2 + g3 + a1 + a2 + a3 + b1 + b2 + b3), 6) AS p_hold, round((g3 + a3 + b3) / (g1 + g2 + g3 + a1 + a2 + a3 + b1 + b2 + b3), 6) AS p_cut_25bp FROM gf")
def _(spark, sf_dir):
    g = fusion.gated(paired(spark, sf_dir), ["a1", "a2", "a3"], ["b1", "b2", "b3"], ["g1", "g2", "g3"])
    out = fusion.mean_of(g, [["g1", "g2", "g3"], ["a1", "a2", "a3"], ["b1", "b2", "b3"]], PROBS)
    return rounded(out, *PROBS).select("entity", "day", *PROBS)


@query("brier_weights", f"""WITH {EVALUATED}, e AS (SELECT {', '.join(f'avg({_SQ(c)}) AS e_{c}' for c in _CL)} FROM tr), w AS (SELECT {', '.join(f'1 / greatest(e_{c}, 0.01) AS w_{c}' for c in _CL)} FROM e)
SELECT {', '.join(f'round(w_{c} / (w_hike_25bp + w_hold + w_cut_25bp), 6) AS weight_{c}' for c in _CL)} FROM w""")
def _(spark, sf_dir):
    return fusion.brier_weights(trailing(spark, sf_dir))


@query("model_vs_model", f"""WITH {BOTH}, r AS (SELECT {ADD_PREDICTED} FROM un), s AS (SELECT a.entity, a.day, (a.predicted_class = a.actual_class)::INTEGER AS x, (b.predicted_class = b.actual_class)::INTEGER AS y, (a.predicted_class = b.predicted_class)::INTEGER AS z
 FROM r a JOIN r b ON a.entity = b.entity AND a.day = b.day WHERE a.model = 'trailing' AND b.model = 'persistence')
SELECT entity, count(*)::BIGINT AS n, round(avg(x), 6) AS accuracy_a, round(avg(y), 6) AS accuracy_b, round(avg(z), 6) AS agreement FROM s GROUP BY 1""")
def _(spark, sf_dir):
    return fusion.compare(metrics.with_prediction(trailing(spark, sf_dir)), metrics.with_prediction(persistent(spark, sf_dir)), ["entity", "day"], "entity")


@query("meeting_overlap_semijoin", f"WITH {EVALUATED} SELECT entity, day, actual_class FROM ps SEMI JOIN (SELECT * FROM mt WHERE decision <> 0) x ON ps.entity = x.entity AND ps.day = x.day")
def _(spark, sf_dir):
    moved = meetings(spark, sf_dir).filter("decision <> 0").select("entity", "day")
    return persistent(spark, sf_dir).join(moved, ["entity", "day"], "left_semi").select("entity", "day", "actual_class")


@query("label_eval_join", f"""WITH {EVALUATED}, e AS (SELECT entity, day, count(*)::BIGINT AS n FROM mt WHERE decision >= 0 GROUP BY 1, 2)
SELECT 'labelled' AS kind, e.entity, e.day, n, actual_class FROM e JOIN ps ON e.entity = ps.entity AND e.day = ps.day UNION ALL SELECT 'unlabelled', e.entity, e.day, n, NULL FROM e ANTI JOIN ps ON e.entity = ps.entity AND e.day = ps.day""")
def _(spark, sf_dir):
    traces = meetings(spark, sf_dir).filter("decision >= 0").groupBy("entity", "day").agg(F.count("*").alias("n"))
    return fusion.label_eval(traces, persistent(spark, sf_dir).select("entity", "day", "actual_class"), ["entity", "day"])


@query("per_meeting_drift", f"""WITH {EVALUATED}, d AS (SELECT *, (month(day) - 1) % 3 AS mi, (meetings % 10) / 10.0::DOUBLE AS pressure FROM tr),
x AS (SELECT entity, day, greatest(0.0::DOUBLE, p_hike_25bp + (mi + day(day) % 3) * 0.02::DOUBLE * pressure) AS h, p_hold AS o, greatest(0.0::DOUBLE, p_cut_25bp - (mi + day(day) % 3) * 0.02::DOUBLE * pressure) AS c FROM d)
SELECT entity, day, round(h / (h + o + c), 6) AS p_hike_25bp, round(o / (h + o + c), 6) AS p_hold, round(c / (h + o + c), 6) AS p_cut_25bp FROM x""")
def _(spark, sf_dir):
    step = (F.month("day") - 1) % 3 + F.dayofmonth("day") % 3
    out = fusion.drift(trailing(spark, sf_dir).withColumn("pressure", (F.col("meetings") % 10) / 10.0), step, F.col("pressure"), PROBS)
    return rounded(out, *PROBS).select("entity", "day", *PROBS)


@query("normalize_probs", f"""WITH {MEETINGS}, r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 100 END AS a, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value / 50 - 0.2 END AS b, (event_id % 3 - 1)::DOUBLE AS c FROM events),
k AS (SELECT event_id, greatest(0.0, least(1.0, coalesce(a, 0)))::DOUBLE AS a, greatest(0.0, least(1.0, CASE WHEN isnan(b) THEN 0 ELSE b END))::DOUBLE AS b, greatest(0.0, least(1.0, c))::DOUBLE AS c FROM r)
SELECT event_id, CASE WHEN a + b + c <= 0 THEN round(1/3, 6) ELSE round(a / (a + b + c), 6) END AS p1, CASE WHEN a + b + c <= 0 THEN round(1/3, 6) ELSE round(b / (a + b + c), 6) END AS p2, CASE WHEN a + b + c <= 0 THEN round(1/3, 6) ELSE round(c / (a + b + c), 6) END AS p3 FROM k""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    a = F.when(F.col("event_id") % 7 != 0, F.col("value") / 100)
    b = F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value") / 50 - 0.2)
    p = rules.normalize_probs(a, b, (F.col("event_id") % 3 - 1).cast("double"))
    return df.select("event_id", *[F.round(x, 6).alias(f"p{i}") for i, x in enumerate(p, 1)])


@query("argmax_class", f"WITH {EVALUATED} SELECT entity, day, predicted_class FROM (SELECT {ADD_PREDICTED} FROM tr)")
def _(spark, sf_dir):
    return metrics.with_prediction(trailing(spark, sf_dir)).select("entity", "day", "predicted_class")


@query("rate_delta_to_probs", """WITH d AS (SELECT event_id, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (value / 100 - 0.5) / 0.25)) AS s FROM events), x AS (SELECT event_id, 0.1::DOUBLE + greatest(0.0::DOUBLE, s) AS h, 0.1::DOUBLE + greatest(0.0::DOUBLE, -s) AS c, 0.2::DOUBLE + greatest(0.0::DOUBLE, 1 - abs(s)) AS o FROM d)
SELECT event_id, round(h / (h + o + c), 6) AS hike, round(o / (h + o + c), 6) AS hold, round(c / (h + o + c), 6) AS cut FROM x""")
def _(spark, sf_dir):
    p = rules.probs_from_delta(F.col("value") / 100 - 0.5)
    return table(spark, sf_dir, "events").select("event_id", *[F.round(x, 6).alias(n) for n, x in zip(("hike", "hold", "cut"), p)])


@query("pinball_loss", """SELECT event_type, round(avg((greatest(-0.9 * (value - 10), 0.1 * (value - 10)) + greatest(-0.5 * (value - 40), 0.5 * (value - 40)) + greatest(-0.1 * (value - 90), 0.9 * (value - 90))) / 3), 4) AS loss FROM events GROUP BY 1""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumns({"q1": F.lit(10.0), "q5": F.lit(40.0), "q9": F.lit(90.0)})
    return df.groupBy("event_type").agg(F.round(metrics.pinball_loss({0.1: "q1", 0.5: "q5", 0.9: "q9"}, "value"), 4).alias("loss"))


@query("model_test_report", f"""WITH {BOTH}, r AS (SELECT {ADD_PREDICTED} FROM un WHERE day > DATE '2024-01-22')
SELECT model, round(avg((actual_class = predicted_class)::INTEGER), 6) AS accuracy, round(count_if(predicted_class = 'hike_25bp') / count(*), 6) AS hike_share, round(count_if(predicted_class = 'hold') / count(*), 6) AS hold_share,
 (SELECT string_agg(predicted_class, ',' ORDER BY day DESC, entity) FROM (SELECT * FROM r b WHERE b.model = r.model ORDER BY day DESC, entity LIMIT 8)) AS last_8 FROM r GROUP BY model""")
def _(spark, sf_dir):
    return fusion.test_report(metrics.with_prediction(both(spark, sf_dir).filter(F.col("day") > "2024-01-22")), ["day", "entity"])
