"""Small hand-made inputs with values derived by hand, and invariants."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.functions import rules, text, urls
from quarterlight.functions.dates import name_to_end, previous_quarter, quarter_range
from quarterlight.operators import corpus, documents, labels, metrics, models, pages, search, timeseries, traces
from quarterlight.scratch import scratch_path
from quarterlight.sources import files
from quarterlight.streaming import events as stream

# The ten labelled quarters of the published validation window (7 hikes, 2 holds, 1 cut), and class shares of the training quarters.
VALIDATION = ["cut_25bp"] + ["hold"] * 2 + ["hike_25bp"] * 7


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_majority_metrics_follow_their_definitions(spark):
    p = {"hike_25bp": 0.5, "hold": 0.3, "cut_25bp": 0.2}
    df = spark.createDataFrame([(c,) for c in VALIDATION], "actual_class string").withColumns({f"p_{c}": F.lit(v) for c, v in p.items()})
    row = one(metrics.forecast_metrics(df))
    brier = np.mean([sum((p[c] - (c == a)) ** 2 for c in p) for a in VALIDATION])
    assert row.accuracy == 0.7 and row.balanced_accuracy == 0.333333 and row.macro_f1 == 0.27451 and row.non_hold_recall == 0.875 and row.hold_collapse_index == 0.0
    assert row.brier_score == pytest.approx(brier, abs=1e-6) and row.log_loss == pytest.approx(-np.mean([np.log(p[a]) for a in VALIDATION]), abs=1e-6)


def test_persistence_metrics_of_the_published_window(spark):
    """Hits .8, misses .1: the published accuracy .7, Brier .48, log loss .846976 of seven hits in ten."""
    rows = [(0, i, c) for i, c in enumerate(["hold", *VALIDATION])]
    df = labels.persistence(spark.createDataFrame(rows, "e int, t int, actual_class string"), "e", "t")
    row = one(metrics.forecast_metrics(df))
    hits = sum(a == b for a, b in zip(["hold", *VALIDATION], VALIDATION))
    assert row.n == 10 and row.accuracy == hits / 10 and row.brier_score == pytest.approx((hits * 0.06 + (10 - hits) * 1.46) / 10)
    assert row.log_loss == pytest.approx(-(hits * np.log(0.8) + (10 - hits) * np.log(0.1)) / 10, abs=1e-6)


def test_no_rows_no_metrics(spark):
    empty = spark.createDataFrame([], "actual_class string, p_hike_25bp double, p_hold double, p_cut_25bp double")
    assert metrics.forecast_metrics(empty).count() == 0 and metrics.calibration_bins(empty).agg(F.sum("count")).first()[0] == 0


def test_period_label_falls_back_on_the_last_move(spark):
    rows = [("a", 1, 1), ("a", 2, -1), ("b", 1, 0), ("c", 1, 1), ("c", 2, 0)]
    out = {r.q: r.actual_class for r in labels.period_labels(spark.createDataFrame(rows, "q string, t int, decision int"), ["q"], ["t"]).collect()}
    assert out == {"a": "cut_25bp", "b": "hold", "c": "hike_25bp"}


def test_calibration_bins_and_edges(spark):
    df = spark.createDataFrame([("hold", 0.0, 1.0, 0.0), ("hold", 0.25, 0.5, 0.25)], "actual_class string, p_hike_25bp double, p_hold double, p_cut_25bp double")
    bins = {(r.label, r.bin): r["count"] for r in metrics.calibration_bins(df, 4).collect()}
    assert len(bins) == 16 and bins["hold", 3] == 1 and bins["hold", 2] == 1 and bins["hike_25bp", 1] == 1 and bins["top", 3] == 1


def test_quarters(spark):
    row = one(spark.range(1).select(name_to_end(F.lit("2024Q1")).alias("e"), previous_quarter(F.lit("2024Q1")).alias("p"), quarter_range(F.lit("2023Q3"), F.lit("2024Q2")).alias("r")))
    assert row.e == dt.date(2024, 3, 31) and row.p == "2023Q4" and row.r == ["2023Q3", "2023Q4", "2024Q1", "2024Q2"]


def test_resample_fills_gaps_and_asof_never_looks_ahead(spark):
    rows = [("a", dt.date(2020, 1, 31), 1.0), ("a", dt.date(2020, 2, 29), 3.0), ("a", dt.date(2020, 8, 31), 5.0)]
    df = spark.createDataFrame(rows, "entity string, ts date, v double")
    q = {str(r.quarter_end): r.v for r in timeseries.resample_quarter(df, {"v": "mean"}).collect()}
    assert q == {"2020-03-31": 2.0, "2020-06-30": None, "2020-09-30": 5.0}
    left = spark.createDataFrame([("a", dt.date(2020, 2, 15)), ("a", dt.date(2019, 1, 1)), ("b", dt.date(2021, 1, 1))], "entity string, at date")
    assert [(str(r.matched_ts), r.v) for r in timeseries.asof_join(left, df, ["entity"], "at", "ts", ["v"]).collect()] == [("2020-01-31", 1.0)]
    assert timeseries.asof_join(left, df, ["entity"], "at", "ts", ["v"], keep_unmatched=True).count() == 3


def test_error_correction_term_loses_one_row(spark):
    df = spark.range(80).selectExpr("'a' AS entity", "id AS quarter_end", "double(id) AS x", "double(id % 7) AS y")
    assert timeseries.error_correction_term(df, {"x": 1.0, "y": -0.5}).count() == 79


def test_var_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    y = np.zeros((64, 2))
    for t in range(1, 64):
        y[t] = y[t - 1] @ np.array([[0.6, 0.1], [-0.2, 0.5]]) + rng.standard_normal(2)
    df = spark.createDataFrame([("a", t, float(a), float(b)) for t, (a, b) in enumerate(y)], "entity string, t int, a double, b double")
    out = models.panel_var(df, ["a", "b"], 1, "entity", "t").orderBy("t").collect()
    x = np.column_stack([np.ones(63), y[:-1]])
    assert len(out) == 63 and np.allclose([[r.fit_a, r.fit_b] for r in out], x @ np.linalg.lstsq(x, y[1:], rcond=None)[0])
    assert one(models.choose_order(df, ["a", "b"], 3, "entity", "t")).p in (1, 2, 3)


def test_rolling_var_needs_a_past(spark):
    df = spark.createDataFrame([("a", t, float(t % 5), float(t)) for t in range(30)], "entity string, t int, a double, b double")
    out = {r.t: r.delta for r in models.rolling_var(df, ["a", "b"], "entity", "t").collect()}
    assert out[10] is None and out[25] is not None


def test_dates_numbers_titles(spark):
    cases = {"monetary20240131a.htm": "2024-01-31", "on 2024/2/9": "2024-02-09", "March 5, 2024": "2024-03-05", "20241399 then 2024-01-02": "2024-01-02", "none": None}
    df = spark.createDataFrame(list(cases), "string").select("value", text.infer_date(F.col("value")).cast("string").alias("d"))
    assert {r.value: r.d for r in df.collect()} == cases
    row = one(spark.range(1).select(text.magnitude_bp(F.lit("up 25 bp")).alias("a"), text.magnitude_bp(F.lit("to 0.5%")).alias("b"), text.magnitude_bp(F.lit("no")).alias("c"), text.parse_number(F.lit("1,234.5 x")).alias("d"), text.parse_number(F.lit("-")).alias("e"), text.canonical_title(F.lit("A  title (pdf)")).alias("f")))
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (25, 50, None, 1234.5, None, "A title")
    row = one(spark.range(1).select(text.sentences(F.lit(" One. Two!  three; four")).alias("s"), text.key_values(F.lit("a=1 b=2.5 a=-3")).alias("m")))
    assert row.s == ["one.", "two!", "three;", "four"] and row.m == {"a": -3.0, "b": 2.5}


def test_policy_rules_with_their_own_words(spark):
    title = F.lit("Bank of England held Bank Rate, inflation persists")
    row = one(spark.range(1).select(rules.stance(title).alias("s"), rules.instrument(title).alias("i"), rules.doc_type(title).alias("d"), rules.actor_country(title).alias("a"), rules.doc_type(F.lit("x"), F.lit("key_rate")).alias("k")))
    assert (row.s, row.i, row.d, row.a.country, row.k) == ("tightening", "policy_rate", "decision", "GBR", "decision")
    row = one(spark.range(1).select(*rules.normalize_probs(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(-1.0))))
    assert list(row) == [1 / 3] * 3


def test_leakage_ignores_audit_dates(spark):
    records = [("a", {"personas_used": {"usa": {"research_cutoff": "2026-07-08"}}}), ("b", {"evidence_chain": [{"published_at": "2024-12-18"}]}), ("c", None)]
    df = spark.createDataFrame([(k, json.dumps(v) if v else "not json", dt.date(2024, 3, 31)) for k, v in records], "k string, js string, cutoff date")
    out = {r.k: (r.mentions, r.future, r.leaked, r.examples) for r in traces.leakage_scan(df, "k", "js", "cutoff").collect()}
    assert out == {"a": (0, 0, False, []), "b": (1, 1, True, ["$.evidence_chain[0].published_at"]), "c": (0, 0, False, [])}


def test_split_rows(spark):
    m = lambda c: [("user", c)]
    rows = [({}, m('{"quarter":"2019Q4"}')), ({"quarter": "2020Q1"}, m("x")), ({}, m('{"quarter":"2024Q2"}')), ({}, m("plain text"))]
    df = spark.createDataFrame(rows, "metadata map<string,string>, messages array<struct<role:string,content:string>>")
    out = df.select(corpus.temporal_evidence(F.col("metadata"), F.col("messages"))["date"].alias("d")).select(corpus.temporal_split(F.col("d")).alias("s"))
    assert sorted(r.s for r in out.collect()) == ["test", "train", "unassigned", "val"]


def test_impact_of_an_outside_shock(spark):
    df = spark.createDataFrame([("RUS", "trade", 0.0, 0.5, 0.5), ("USA", "hike", 0.1, 0.11, 0.01)], "cluster string, field string, factual double, counterfactual double, delta double")
    out = {r.cluster: (r.label, r.external) for r in traces.impact(df, ["cluster"], ["hike"], [], ["trade"]).collect()}
    assert out == {"RUS": ("external-pressure shock", 0.5), "USA": ("little strategic change", 0.0)}


def test_persona_agrees_with_itself(spark):
    p = spark.createDataFrame([("r", 0.3, 0.7)], "role string, a double, b double")
    priors = p.select("role", F.col("a").alias("prior_a"), F.col("b").alias("prior_b"))
    assert one(traces.persona_consistency(p, priors, ["role"], "role", ["a", "b"])).score == 1.0


def test_crawl_stays_on_its_host(spark):
    site = "http://a.org"
    df = spark.createDataFrame([(f"{site}/", f"<a href='/x'>x</a><a href='y#top'>y</a><a href='http://b.org/z'>z</a><a href='/n'></a>"), (f"{site}/x", "<time datetime='2024-01-02'>d</time><p>X<br>more"), (f"{site}/y", "<p>Y")], "url string, html string")
    links = pages.page_links(df.withColumn("id", F.lit(1)), "url")
    reached = pages.crawl(df, links.select("url", "target"), df.filter(F.col("url") == f"{site}/"), 3)
    assert sorted((r.url, r.depth) for r in reached.collect()) == [(f"{site}/", 0), (f"{site}/x", 1), (f"{site}/y", 1)]
    docs = {r.url: r for r in pages.extract_documents(df, "url").collect()}
    assert docs[f"{site}/x"].published == "2024-01-02" and docs[f"{site}/x"].text == "X more"
    hashed = docs_hash = df.select("url", text.text_hash(F.col("html")).alias("h"))
    assert documents.unseen(hashed, docs_hash.limit(0), "h", ["url"]).count() == 3 and documents.unseen(hashed, docs_hash, "h", ["url"]).count() == 0


def test_urls(spark):
    df = spark.createDataFrame([("http://a.org?x=1#y",), ("HTTPS://a.org/p#q",), ("ftp://a.org/",), (None,)], "u string").select(urls.canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == ["http://a.org/?x=1", "HTTPS://a.org/p", None, None]


def test_decode_bytes(spark):
    raw = [b'<meta charset="iso-8859-1">\xe9', "é".encode(), "中".encode("gb18030"), None, b"charset=nonsense \xff"]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "b binary").select(pages.decode_bytes("b")).collect()]
    assert out[0].endswith("é") and out[1] == "é" and out[2] == "中" and out[3] is None and out[4]


def test_sentence_selection(spark):
    df = spark.createDataFrame([(1, "Lunch logistics were settled. Inflation remains elevated above two percent. Chairs moved."), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in search.tfidf_select(df, "inflation remains elevated two percent objective", ["the", "were"], k=1).collect()}
    assert out[1] == "inflation remains elevated above two percent." and not out.get(2) and not out[3]


def test_even_sample_places(spark):
    df = spark.createDataFrame([(i, 2020) for i in range(10)], "i int, y int")
    assert sorted(r.i for r in documents.even_sample(df, F.col("y"), ["i"], 4).collect()) == [0, 3, 6, 9]
    assert [r.i for r in documents.even_sample(df, F.col("y"), ["i"], 1).collect()] == [5]


def test_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "FEDFUNDS.json").write_text(json.dumps({"observations": [{"date": "2020-01-01", "value": "1.5"}, {"date": "2020-02-01", "value": "."}, {"date": "bad", "value": "2"}]}, indent=1))
    assert [tuple(r) for r in files.read_series_json(spark, f"file://{tmp_path}/s").collect()] == [("FEDFUNDS", dt.date(2020, 1, 1), 1.5)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = files.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", "a int").collect()
    assert [r.a for r in rows if r._corrupt_record is None] == [1, 2] and sum(r._corrupt_record is not None for r in rows) == 1
    assert files.read_jsonl(spark, f"file://{tmp_path}/missing", "a int").count() == 0
    (tmp_path / "c.csv").write_text("Speech_Date,Institution,Headline,Content\n2020-01-01,ECB,Title,Some text\n")
    assert one(files.read_speech_csv(spark, f"file://{tmp_path}/c.csv")).text_chars == 9


def test_extract_first_json(spark):
    cases = {'x {"a": "}", "b": {"c": 1}} {"d": 2}': '{"a": "}", "b": {"c": 1}}', "none": None, "{broken": None, "[1]": None}
    df = spark.createDataFrame(list(cases), "string").select("value", traces.first_json("value").alias("j"))
    assert {r.value: r.j for r in df.collect()} == cases


def test_stream_equals_batch_and_replays_add_nothing(spark):
    rows = [(f"e{i % 7}", None, "energy_shock" if i % 2 else "note", f"2026-0{1 + i % 6}-10 00:00:00", None, None, ["s"], json.dumps({"energy_risk": i})) for i in range(14)]
    df = spark.createDataFrame(rows, stream.RAW)
    path, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    df.write.json(path)
    events = stream.deduplicated(stream.normalize(stream.file_source(spark, path)), "400 days")
    for _ in range(2):
        stream.run_available(events, stream.archive(out), check)
    found = spark.read.parquet(out)
    assert sorted(r.event_id for r in found.collect()) == [f"e{i}" for i in range(7)]
    df.write.mode("append").json(path)  # the same events once more
    stream.run_available(events, stream.archive(out), check)
    assert spark.read.parquet(out).count() == 7


def test_requests_and_quarters(spark):
    rows = [("a", None, "energy_shock", "2026-04-02T00:00:00Z", None, None, ["s"], '{"scenario_name":"x","energy_risk":0.9,"geopolitical_escalation":0.8,"max_rounds":2}'), ("b", None, "note", "2026-12-31T23:59:00Z", None, None, None, "free text")]
    events = stream.normalize(spark.createDataFrame(rows, stream.RAW))
    asked = one(stream.counterfactual_requests(events, ["energy_risk", "geopolitical_escalation"]))
    assert asked.quarter == "2026Q2" and len(asked.overrides) == 2 and asked.max_rounds == 2
    other = one(events.filter("event_id = 'b'").select(stream.active_quarter(F.col("as_of")).alias("q"), "payload"))
    assert other.q == "2026Q4" and json.loads(other.payload) == {"raw": "free text"}


def test_partition_counts_do_not_matter(spark, sf_dir):
    from quarterlight.queries import QUERIES
    from tests.compare import spark_rows

    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append([spark_rows(QUERIES[q](spark, sf_dir)) for q in ("forecast_metrics", "own_history", "asof_features_join")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_unreadable_snapshots_are_rebuilt(spark, tmp_path):
    from quarterlight.sources.files import snapshots_or_rebuilt

    index = spark.createDataFrame([(1, "US", "2020-01-01", "text")], "id long, country string, date string, text string")
    for name, data in (("empty", None), ("broken", b"not parquet at all")):
        folder = tmp_path / name
        folder.mkdir()
        if data:
            (folder / "part.parquet").write_bytes(data)
        assert [r.origin for r in snapshots_or_rebuilt(spark, str(folder), index).collect()] == ["rebuilt"]


def test_chart_rates(spark):
    from quarterlight.operators.pages import chart_rates

    script = 'x = {"categories": ["01.02.2024", "bad", "05.03.2024", "06.03.2024"], "series": [{"data": ["a"]}, {"data": [16.0, 15.5]}]}'
    pages = spark.createDataFrame([(1, script), (2, None), (3, "<p>no chart</p>")], "id long, html string")
    assert [(r.id, str(r.date), r.rate) for r in chart_rates(pages, "id").collect()] == [(1, "2024-02-01", 16.0), (1, "2024-03-05", 15.5)]
