"""Models over the orders (by month and priority) and the documents' labels."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarterlight.functions.rules import probs_from_delta
from quarterlight.operators import boosting, metrics, models
from quarterlight.operators import timeseries as ts
from quarterlight.queries.panels import MONTHS, months
from quarterlight.queries.registry import query, table

FEATURES = ["chars", "words", "lines", "commas", "upper", "digits"]


def labelled(spark, sf_dir):
    """Features of the documents' texts with their quality label and a date."""
    d = table(spark, sf_dir, "documents")
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    x = d.select("doc_id", F.length("text").cast("double").alias("chars"), count(r"\S+").alias("words"), count(r"\n").alias("lines"), count(",").alias("commas"), count("[A-Z]").alias("upper"), count("[0-9]").alias("digits"))
    day = F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") * 7 % 2000).cast("int"))
    return models.temporal_split(x.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("day", day), "day", "2021-12-31", "2022-06-30")


def fitted(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return models.balanced_logistic(rows.filter("split = 'train'"), FEATURES, "quality"), rows


@query("temporal_split", "SELECT doc_id, CASE WHEN DATE '2018-01-01' + (doc_id * 7 % 2000)::INTEGER <= DATE '2021-12-31' THEN 'train' WHEN DATE '2018-01-01' + (doc_id * 7 % 2000)::INTEGER <= DATE '2022-06-30' THEN 'val' ELSE 'test' END AS split FROM labels")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "split")


@query("usable_features", "SELECT 'full' AS feature WHERE (SELECT count(*) FROM labels) > 50 UNION ALL SELECT 'half' WHERE (SELECT count(*) FROM labels WHERE doc_id % 2 = 0) > 50")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select(F.lit(1.0).alias("full"), F.when(F.col("doc_id") % 2 == 0, 1.0).alias("half"), F.when(F.col("doc_id") < 10, 1.0).alias("few"))
    names = models.usable_features(df, df.columns)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("standardize", """WITH f AS (SELECT d.doc_id, length(text)::DOUBLE AS chars, DATE '2018-01-01' + (d.doc_id * 7 % 2000)::INTEGER <= DATE '2021-12-31' AS train FROM documents d JOIN labels l ON d.doc_id = l.doc_id), s AS (SELECT avg(chars) AS m, stddev_samp(chars) AS s FROM f WHERE train)
SELECT doc_id, round((chars - m) / s, 5) AS chars FROM f, s""")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    scaler = models.standardize(rows.filter("split = 'train'"), ["chars"])
    return scaler.transform(rows).select("doc_id", F.round(vector_to_array("scaled")[0], 5).alias("chars"))


@query("balanced_logistic")
def _(spark, sf_dir):
    model, rows = fitted(spark, sf_dir)
    scored = models.with_probabilities(model, rows, ["p0", "p1"])
    p = F.when(F.col("quality") == 1, F.col("p1")).otherwise(F.col("p0"))
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("quality")).cast("int")), 4).alias("accuracy"), F.round(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))), 4).alias("log_loss"))


@query("score_latest")
def _(spark, sf_dir):
    model, rows = fitted(spark, sf_dir)
    newest = rows.groupBy((F.col("doc_id") % 10).alias("entity")).agg(F.max_by(F.struct(*rows.columns), F.struct("day", "doc_id")).alias("r")).select("entity", "r.*")
    return models.with_probabilities(model, newest, ["p0", "p1"]).select("entity", "doc_id", F.round("p0", 5).alias("p0"), F.round("p1", 5).alias("p1"))


@query("top_coefficients")
def _(spark, sf_dir):
    model, _rows = fitted(spark, sf_dir)
    return models.coefficients(model, FEATURES, 1)


@query("permutation_importance")
def _(spark, sf_dir):
    model, rows = fitted(spark, sf_dir)
    return models.permutation_importance(model, rows.filter("split <> 'train'"), FEATURES, "doc_id").orderBy(F.desc("importance"), "feature").limit(8)


@query("gbt_early_stop")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("y", F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality"))).cache()
    model = boosting.boosted_softmax(rows.filter("split = 'train'"), rows.filter("split = 'val'"), FEATURES, "y", [0, 1, 2])
    scored = model.score(rows, ["p0", "p1", "p2"])
    p = F.element_at(F.array("p0", "p1", "p2"), F.col("y") + 1)
    right = (p >= F.greatest("p0", "p1", "p2")).cast("int")
    return scored.groupBy("split").agg(F.lit(model.best).alias("stages"), F.count("*").alias("n"), F.round(F.avg(right), 4).alias("accuracy"), F.round(F.avg(-F.ln(F.greatest(p, F.lit(1e-15)))), 4).alias("log_loss"))


def quarterly_moves(spark, sf_dir):
    """Monthly values with the next move's class: 0 down, 1 about equal, 2 up."""
    q = months(spark, sf_dir).withColumn("value", F.col("value") / 1e6).withColumn("n", F.col("n").cast("double"))
    by = {"order": "ts"}
    f = q.withColumns({"d": ts.first_difference("value", **by), "d_n": ts.first_difference("n", **by)}).withColumn("lag_d", ts.lagged("d", 1, order="ts")).withColumn("lag_n", ts.lagged("d_n", 1, order="ts"))
    move = F.when(F.col("d") > 0.3, 2).when(F.col("d") < -0.3, 0).otherwise(1)
    return f.dropna().withColumn("y", move)


@query("ordered_probit_baseline")
def _(spark, sf_dir):
    rows = quarterly_moves(spark, sf_dir)
    fit = models.ordered_probit(rows.filter("ts < DATE'2000-01-01'"), ["lag_d", "lag_n"], "y")
    names = ["p_hike_25bp", "p_hold", "p_cut_25bp"]
    scored = models.score_probit(fit, rows.filter("ts >= DATE'2000-01-01'"), names)
    actual = F.when(F.col("y") == 0, "hike_25bp").when(F.col("y") == 1, "hold").otherwise("cut_25bp")
    return metrics.forecast_metrics(scored.withColumn("actual_class", actual))


VAR = f"""{MONTHS}, l AS (SELECT entity, ts, value / 1e6 AS y, n::DOUBLE AS n, lag(value / 1e6) OVER w AS y1, lag(n::DOUBLE) OVER w AS n1 FROM m WINDOW w AS (PARTITION BY entity ORDER BY ts)), r AS (SELECT * FROM l WHERE y1 IS NOT NULL),
c AS (SELECT entity, covar_pop(y1, y1) AS a, covar_pop(y1, n1) AS b, covar_pop(n1, n1) AS d, covar_pop(y1, y) AS p, covar_pop(n1, y) AS q, avg(y) AS my, avg(y1) AS m1, avg(n1) AS mn FROM r GROUP BY 1),
k AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS b1, (q * a - p * b) / (a * d - b * b) AS b2 FROM c)"""


@query("panel_var", f"WITH {VAR} SELECT r.entity, r.ts, round(my + b1 * (y1 - m1) + b2 * (n1 - mn), 4) AS fit FROM r JOIN k ON r.entity = k.entity")
def _(spark, sf_dir):
    panel = months(spark, sf_dir).withColumns({"y": F.col("value") / 1e6, "n": F.col("n").cast("double")})
    return models.panel_var(panel, ["y", "n"], 1, "entity", "ts").select("entity", "ts", F.round("fit_y", 4).alias("fit"))


@query("var_order")
def _(spark, sf_dir):
    panel = months(spark, sf_dir).withColumns({"y": F.col("value") / 1e6, "n": F.col("n").cast("double")})
    return models.choose_order(panel, ["y", "n"], 8, "entity", "ts")


@query("panel_var_by_order")
def _(spark, sf_dir):
    panel = months(spark, sf_dir).withColumns({"y": F.col("value") / 1e6, "n": F.col("n").cast("double")})
    return models.panel_var_by_order(panel, ["y", "n"], 8, "entity", "ts").select("entity", "ts", "p", F.round("fit_y", 4).alias("fit"), F.round("res_y", 4).alias("residual"))


@query("rolling_var_direction")
def _(spark, sf_dir):
    panel = months(spark, sf_dir).withColumns({"y": F.col("value") / 1e6, "n": F.col("n").cast("double")})
    out = models.rolling_var(panel, ["y", "n"], "entity", "ts")
    p = [F.coalesce(x, F.lit(prior)) for x, prior in zip(probs_from_delta(F.col("delta")), (0.2, 0.65, 0.15))]
    return out.select("entity", "ts", *[F.round(x, 5).alias(c) for x, c in zip(p, ("hike", "hold", "cut"))])


@query("long_run_relation", f"""WITH {MONTHS}, x AS (SELECT entity, ts, value / 1e6 AS y, n::DOUBLE AS n FROM m), b AS (SELECT entity, regr_slope(y, n) AS slope FROM x GROUP BY 1)
SELECT x.entity, x.ts, round(lag(y - slope * n) OVER (PARTITION BY x.entity ORDER BY x.ts), 4) AS ect FROM x JOIN b ON x.entity = b.entity QUALIFY lag(y - slope * n) OVER (PARTITION BY x.entity ORDER BY x.ts) IS NOT NULL""")
def _(spark, sf_dir):
    panel = months(spark, sf_dir).select("entity", "ts", (F.col("value") / 1e6).alias("y"), F.col("n").cast("double").alias("n")).withColumn("one", F.lit(1.0))
    beta = models.solve(models.gram_sums(panel, ["one", "n"], ["y"], ["entity"]), "entity", 2, 1, 3, ridge=0.0)
    combined = panel.join(beta, "entity").withColumn("combined", F.col("y") - F.col("beta")[1] * F.col("n"))
    return ts.error_correction_term(combined, {"combined": 1.0}, order="ts").select("entity", "ts", F.round("ect", 4).alias("ect"))


@query("linear_probe")
def _(spark, sf_dir):
    rows = quarterly_moves(spark, sf_dir)
    seq = ts.sequence_windows(rows, ["d", "d_n"], 4, "entity", "ts")
    flat = seq.select("entity", "ts", "y", *[F.flatten("sequence")[i].alias(f"x{i}") for i in range(8)])
    model = models.balanced_logistic(flat.filter("ts < DATE'2000-01-01'"), [f"x{i}" for i in range(8)], "y")
    names = ["p_hike_25bp", "p_hold", "p_cut_25bp"]
    scored = models.with_probabilities(model, flat.filter("ts >= DATE'2000-01-01'"), names)
    scored = scored.withColumns({n: F.lit(0.0) for n in names if n not in scored.columns})
    actual = F.when(F.col("y") == 0, "hike_25bp").when(F.col("y") == 1, "hold").otherwise("cut_25bp")
    return metrics.forecast_metrics(scored.withColumn("actual_class", actual)).select("n", "accuracy", "brier_score", "log_loss")


@query("stacking_fusion")
def _(spark, sf_dir):
    from quarterlight.queries.metrics import paired

    both = paired(spark, sf_dir).withColumn("apart", F.abs(F.col("a1") - F.col("b1"))).withColumn("y", F.when(F.col("actual_class") == "hike_25bp", 0).when(F.col("actual_class") == "hold", 1).otherwise(2))
    x = ["a1", "a2", "a3", "b1", "b2", "b3", "apart"]
    model = models.balanced_logistic(both.filter("day <= DATE'2024-01-20'"), x, "y", reg=0.1)
    names = ["q0", "q1", "q2"]
    late = models.with_probabilities(model, both.filter("day > DATE'2024-01-20'"), names)
    p = [F.col(n) if n in late.columns else F.lit(0.0) for n in names]
    return late.select("entity", "day", *[F.round(v, 5).alias(c) for v, c in zip(p, ("p_hike_25bp", "p_hold", "p_cut_25bp"))])
