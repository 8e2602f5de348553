"""Inventories, events, cards, histories, snapshots and search over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlight.functions import rules
from quarterlight.functions.text import text_hash
from quarterlight.operators import documents as docs
from quarterlight.operators import search, timeseries
from quarterlight.queries.registry import query, table

INV = """iv AS (SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, year(o_orderdate)::INTEGER AS year, o_orderpriority AS country, CASE o_orderstatus WHEN 'P' THEN 'fetch_error' ELSE o_orderstatus END AS doc_type,
 CASE o_orderkey % 3 WHEN 0 THEN 'http://x.org/' || o_orderkey || '.html' WHEN 1 THEN 'http://x.org/' || o_orderkey || '.pdf' ELSE 'http://x.org/' || o_orderkey END AS url FROM orders)"""


def inventory(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    end = F.when(k == 0, ".html").when(k == 1, ".pdf").otherwise("")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("country"),
        F.when(F.col("o_orderstatus") == "P", "fetch_error").otherwise(F.col("o_orderstatus")).alias("doc_type"), F.concat(F.lit("http://x.org/"), F.col("o_orderkey").cast("string"), end).alias("url"),
    )


@query("filter_inventory", f"WITH {INV} SELECT * FROM iv WHERE year BETWEEN 1996 AND 1999 AND country IN ('1-URGENT', '5-LOW') AND doc_type <> 'fetch_error'")
def _(spark, sf_dir):
    return docs.filter_inventory(inventory(spark, sf_dir), (1996, 1999), ["1-URGENT", "5-LOW"])


@query("prefer_best_document", f"WITH {INV} SELECT id, date, country, doc_type, url FROM iv QUALIFY row_number() OVER (PARTITION BY date, country, doc_type ORDER BY CASE WHEN suffix(url, '.html') THEN 0 WHEN suffix(url, '.pdf') THEN 1 ELSE 2 END, url) = 1")
def _(spark, sf_dir):
    return docs.prefer_best(inventory(spark, sf_dir), ["date", "country", "doc_type"], rules.document_rank(F.col("url")), ["url"]).select("id", "date", "country", "doc_type", "url")


@query("union_inventory_dedup", f"WITH {INV}, u AS (SELECT id, date, country, doc_type, CASE WHEN id % 2 = 0 THEN url END AS url, NULL AS note FROM iv UNION ALL SELECT id, date, country, doc_type, NULL, CASE WHEN id % 3 = 0 THEN 'second' END FROM iv) SELECT id, date, country, doc_type, url, note FROM u QUALIFY row_number() OVER (PARTITION BY id, date, country, doc_type ORDER BY url NULLS LAST, note NULLS LAST) = 1")
def _(spark, sf_dir):
    iv = inventory(spark, sf_dir)
    keys = ["id", "date", "country", "doc_type"]
    one, two = iv.select(*keys, F.when(F.col("id") % 2 == 0, F.col("url")).alias("url")), iv.select(*keys, F.when(F.col("id") % 3 == 0, "second").alias("note"))
    return docs.union_dedup([one, two], ["id", "date", "country", "doc_type"], ["url", "note"])


EV = "ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS date, user_id, (user_id % 5)::BIGINT AS country, event_type, event_type || '.' || (event_id % 3)::VARCHAR AS strategy_key, value FROM events)"


def events(spark, sf_dir):
    key = F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("ts").cast("date").alias("date"), "user_id", (F.col("user_id") % 5).alias("country"), "event_type", key.alias("strategy_key"), "value")


CARDS = f"""{EV}, co AS (SELECT strategy_key, country, count(*) AS n FROM ev GROUP BY 1, 2), mo AS (SELECT strategy_key, country AS top_country FROM co QUALIFY row_number() OVER (PARTITION BY strategy_key ORDER BY n DESC, country) = 1),
la AS (SELECT strategy_key, list(event_id ORDER BY ts, event_id) AS ex FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY strategy_key ORDER BY ts DESC, event_id DESC) <= 8) GROUP BY 1),
cd AS (SELECT e.strategy_key, any_value(event_type) AS event_type, any_value(top_country) AS country, count(*)::BIGINT AS support, array_to_string(list_sort(list(DISTINCT e.country)), ',') AS countries FROM ev e JOIN mo ON e.strategy_key = mo.strategy_key GROUP BY 1)"""


def cards(spark, sf_dir):
    return docs.strategy_cards(events(spark, sf_dir).withColumn("seen", F.col("country")), "strategy_key", ["event_type", "country"], ["event_id", "date"], ["ts", "event_id"], "seen")


@query("strategy_cards", f"WITH {CARDS} SELECT cd.*, array_to_string(ex, ',') AS examples FROM cd JOIN la ON cd.strategy_key = la.strategy_key")
def _(spark, sf_dir):
    ids = F.array_join(F.transform("examples", lambda x: x["event_id"].cast("string")), ",")
    return cards(spark, sf_dir).select("strategy_key", "event_type", "country", "support", F.array_join(F.transform("countries", lambda c: c.cast("string")), ",").alias("countries"), ids.alias("examples"))


@query("card_order", f"WITH {CARDS} SELECT row_number() OVER (ORDER BY support DESC, strategy_key)::INTEGER AS place, strategy_key, support FROM cd")
def _(spark, sf_dir):
    from pyspark.sql import Window

    # cards are one row for each strategy key
    return cards(spark, sf_dir).select(F.row_number().over(Window.orderBy(F.desc("support"), "strategy_key")).alias("place"), "strategy_key", "support")


@query("card_asof_filter_join", f"""WITH {CARDS}, x AS (SELECT cd.strategy_key, unnest(ex) AS event_id, generate_subscripts(ex, 1) AS k FROM cd JOIN la ON cd.strategy_key = la.strategy_key),
s AS (SELECT x.strategy_key, e.date, x.event_id, k FROM x JOIN ev e ON e.event_id = x.event_id)
SELECT e.event_id, coalesce((SELECT string_agg(y.event_id::VARCHAR, ',' ORDER BY k) FROM (SELECT * FROM s WHERE s.strategy_key = e.strategy_key AND s.date <= e.date ORDER BY k LIMIT 5) y), '') AS examples FROM ev e""")
def _(spark, sf_dir):
    out = docs.card_asof(events(spark, sf_dir).select("event_id", "strategy_key", F.col("date").alias("as_of")), cards(spark, sf_dir), "strategy_key", "as_of")
    return out.select("event_id", F.array_join(F.transform("examples", lambda x: x["event_id"].cast("string")), ",").alias("examples"))


@query("own_history", f"""WITH {EV}, h AS (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h FROM ev)
SELECT event_id, coalesce(array_to_string(h, ','), '') AS history FROM h""")
def _(spark, sf_dir):
    out = timeseries.own_history(events(spark, sf_dir), ["event_id"], 12, "user_id", ["ts", "event_id"])
    return out.select("event_id", F.array_join(F.transform("history", lambda x: x["event_id"].cast("string")), ",").alias("history"))


OTHERS = f"""{EV}, po AS (SELECT event_id, country, row_number() OVER (ORDER BY ts, event_id) AS pos FROM ev),
fo AS (SELECT f.c AS for_c, event_id, pos, row_number() OVER (PARTITION BY f.c ORDER BY pos) AS k FROM po, (SELECT unnest(range(5)) AS c) f WHERE po.country <> f.c),
ow AS (SELECT event_id, country, pos, pos - row_number() OVER (PARTITION BY country ORDER BY pos) AS nf FROM po),
oh AS (SELECT ow.event_id, count(fo.event_id)::INTEGER AS n, coalesce(string_agg(fo.event_id::VARCHAR, ',' ORDER BY fo.k), '') AS others FROM ow LEFT JOIN fo ON fo.for_c = ow.country AND fo.k > nf - 20 AND fo.k <= nf GROUP BY 1)"""


def with_others(spark, sf_dir):
    return timeseries.other_history(events(spark, sf_dir), ["event_id"], 20, "country", ["ts", "event_id"])


@query("other_history", f"WITH {OTHERS} SELECT event_id, n, others FROM oh")
def _(spark, sf_dir):
    return with_others(spark, sf_dir).select("event_id", F.size("others").alias("n"), F.array_join(F.transform("others", lambda x: x["event_id"].cast("string")), ",").alias("others"))


@query("context_snapshots", f"""WITH {OTHERS}, ow2 AS (SELECT event_id, count(*) OVER (PARTITION BY country ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)::INTEGER AS own_n FROM ev),
dv AS (SELECT country, date, event_type, arg_max(value, (ts, event_id)) AS v FROM ev GROUP BY 1, 2, 3),
mc AS (SELECT g.country, g.date, f.event_type, arg_max(f.v, f.date) AS v FROM (SELECT DISTINCT country, date FROM ev) g JOIN dv f ON f.country = g.country AND f.date < g.date GROUP BY 1, 2, 3),
mm AS (SELECT country, date, round(max(CASE WHEN event_type = 'click' THEN v END), 4) AS click, count(*)::INTEGER AS macros FROM mc GROUP BY 1, 2)
SELECT e.event_id, own_n, oh.n AS other_n, coalesce(macros, 0)::INTEGER AS macros, click, e.event_type || ' | ' || e.country || ' | ' || e.date AS rag_text FROM ev e JOIN ow2 ON e.event_id = ow2.event_id JOIN oh ON e.event_id = oh.event_id LEFT JOIN mm ON e.country = mm.country AND e.date = mm.date""")
def _(spark, sf_dir):
    from quarterlight.plans.snapshots import context_snapshots

    snaps = context_snapshots(events(spark, sf_dir), "country", "event_type", "value")
    return snaps.select("event_id", F.size("own").alias("own_n"), F.size("others").alias("other_n"), F.coalesce(F.size("macro"), F.lit(0)).alias("macros"), F.round(F.col("macro")["click"]["value"], 4).alias("click"), "rag_text")


@query("event_context_left_join", f"WITH {EV}, c AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || '!' END AS note FROM ev) SELECT ev.event_id, coalesce(note, '{{}}') AS note FROM ev LEFT JOIN c ON ev.event_id = c.event_id")
def _(spark, sf_dir):
    ev = events(spark, sf_dir)
    contexts = ev.select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit("!"))).alias("note"))
    return docs.with_context(ev.select("event_id"), contexts, "event_id", {"note": F.lit("{}")})


@query("rag_documents", f"WITH {EV} SELECT event_id, event_type || ' ' || country AS search_text, md5('event_id: ' || event_id || chr(10) || 'date: ' || date || chr(10) || 'strategy_key: ' || strategy_key) AS text FROM ev")
def _(spark, sf_dir):
    out = docs.rag_records(events(spark, sf_dir), ["event_type", "country"], ["event_id", "date", "strategy_key"])
    return out.select("event_id", "search_text", F.md5(F.col("text").cast("binary")).alias("text"))


@query("year_even_sample", f"""WITH {INV}, p AS (SELECT id, year, row_number() OVER (PARTITION BY year ORDER BY date, id) - 1 AS p, count(*) OVER (PARTITION BY year) AS n FROM iv), w AS (SELECT DISTINCT year, round_even(i * (n - 1) / 6.0::DOUBLE, 0)::BIGINT AS p FROM p, (SELECT unnest(range(7)) AS i))
SELECT p.id, p.year FROM p SEMI JOIN w ON p.year = w.year AND p.p = w.p""")
def _(spark, sf_dir):
    return docs.even_sample(inventory(spark, sf_dir), F.col("year"), ["date", "id"], 7).select("id", "year")


@query("limit_per_source", f"WITH {EV} SELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def _(spark, sf_dir):
    return docs.first_by(events(spark, sf_dir), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


@query("seen_hash_antijoin", r"""WITH h AS (SELECT doc_id, source, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents) SELECT doc_id FROM h WHERE source <> 'src0' AND hash NOT IN (SELECT hash FROM h WHERE source = 'src0') QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1""")
def _(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", "source", text_hash(F.col("text")).alias("hash"))
    return docs.unseen(hashed.filter("source <> 'src0'"), hashed.filter("source = 'src0'"), "hash", ["doc_id"]).select("doc_id")


RECORDS = "rc AS (SELECT doc_id, DATE '2020-01-01' + (doc_id % 400)::INTEGER AS date, text FROM documents), qs AS (SELECT item_id AS query_id, text AS query, DATE '2020-01-01' + (100 + item_id * 13 % 350)::INTEGER AS as_of FROM benchmark)"


def records(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("date"), "text")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.date_add(F.lit("2020-01-01").cast("date"), (100 + F.col("item_id") * 13 % 350).cast("int")).alias("as_of"))


@query("keyword_search_recency", f"""WITH {RECORDS}, dt AS (SELECT doc_id, w, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM rc) GROUP BY 1, 2), qt AS (SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS w FROM qs) GROUP BY 1, 2),
o AS (SELECT query_id, doc_id, sum(least(n, m)) AS ov FROM qt JOIN dt ON qt.w = dt.w GROUP BY 1, 2),
s AS (SELECT qs.query_id, rc.doc_id, round(coalesce(ov, 0) + 2 / sqrt((as_of - date) / 30.0::DOUBLE + 1), 9) AS score FROM qs JOIN rc ON rc.date <= qs.as_of LEFT JOIN o ON o.query_id = qs.query_id AND o.doc_id = rc.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 8""")
def _(spark, sf_dir):
    return search.search_recent(asked(spark, sf_dir), records(spark, sf_dir), 8)


@query("keyword_search_set", f"""WITH {RECORDS}, f AS (SELECT doc_id, date, list_distinct(list_filter(string_split_regex(translate(lower(text), '_-', '  '), '\\s+'), lambda w: length(w) > 2)) AS ws FROM rc),
dt AS (SELECT doc_id, date, unnest(ws) AS w FROM f), qt AS (SELECT query_id, as_of, unnest(list_distinct(list_filter(string_split_regex(translate(lower(query), '_-', '  '), '\\s+'), lambda w: length(w) > 2))) AS w FROM qs),
s AS (SELECT query_id, doc_id, count(*) + CASE WHEN year(date) = year(as_of) THEN 0.01 ELSE 0 END::DOUBLE AS score FROM qt JOIN dt ON qt.w = dt.w WHERE date <= as_of GROUP BY query_id, doc_id, date, as_of)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 5""")
def _(spark, sf_dir):
    return search.search_sets(asked(spark, sf_dir).withColumnRenamed("as_of", "before"), records(spark, sf_dir), 5)


ANCHOR = "the inflation of this er and with erth onst; price stability that on in"
STOP = ["the", "of", "and", "to", "in", "is", "a"]


@query("tfidf_context_select", r"""WITH RECURSIVE se AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM documents),
sp AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS i, len(ss) AS n FROM se),
wd AS (SELECT doc_id, i, n, sentence, list_filter(regexp_extract_all(sentence, '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN ('the', 'of', 'and', 'to', 'in', 'is', 'a')) AS w FROM sp),
gr AS (SELECT doc_id, i, n, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])), list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2]))) AS g FROM wd),
tm AS (SELECT doc_id, i, n, g, count(*) AS tf FROM gr GROUP BY 1, 2, 3, 4),
qw AS (SELECT list_filter(regexp_extract_all('the inflation of this er and with erth onst; price stability that on in', '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN ('the', 'of', 'and', 'to', 'in', 'is', 'a')) AS w),
qg AS (SELECT g, count(*) AS qtf FROM (SELECT unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])), list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2]))) AS g FROM qw) GROUP BY 1),
df AS (SELECT doc_id, n, tm.g, qtf, ln((n + 2) / (count(*) + (qtf IS NOT NULL)::INTEGER + 1.0)::DOUBLE) + 1 AS idf FROM tm LEFT JOIN qg ON tm.g = qg.g GROUP BY doc_id, n, tm.g, qtf),
qn AS (SELECT se.doc_id, sqrt(sum(pow(qg.qtf * coalesce(df.idf, ln((len(ss) + 2) / 2.0::DOUBLE) + 1), 2))) AS qnorm FROM se CROSS JOIN qg LEFT JOIN df ON df.doc_id = se.doc_id AND df.g = qg.g GROUP BY 1),
sc AS (SELECT tm.doc_id, tm.i, coalesce(sum(tf * qtf * idf * idf), 0) / (sqrt(sum(pow(tf * idf, 2))) * any_value(qnorm)) AS score FROM tm JOIN df ON tm.doc_id = df.doc_id AND tm.g = df.g JOIN qn ON qn.doc_id = tm.doc_id GROUP BY 1, 2),
rk AS (SELECT sp.doc_id, sp.i, sp.sentence, row_number() OVER (PARTITION BY sp.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, sp.i) AS r FROM sp LEFT JOIN sc ON sc.doc_id = sp.doc_id AND sc.i = sp.i),
st(doc_id, r, chars, kept) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT doc_id FROM sp)
 UNION ALL SELECT st.doc_id, st.r + 1, CASE WHEN st.chars < 1000 AND (st.chars = 0 OR st.chars + length(sentence) + 1 <= 1000) THEN st.chars + length(sentence) + 1 ELSE st.chars END, CASE WHEN st.chars < 1000 AND (st.chars = 0 OR st.chars + length(sentence) + 1 <= 1000) THEN list_append(kept, i) ELSE kept END
 FROM st JOIN rk ON rk.doc_id = st.doc_id AND rk.r = st.r + 1 WHERE st.r < 12)
SELECT se.doc_id, len(ss)::INTEGER AS n_sentences, coalesce(array_to_string(list_sort(arg_max(kept, r)), ','), '') AS selected FROM se LEFT JOIN st ON st.doc_id = se.doc_id GROUP BY se.doc_id, ss""")
def _(spark, sf_dir):
    out = search.tfidf_select(table(spark, sf_dir, "documents").select("doc_id", "text"), ANCHOR, STOP, k=12, max_chars=1000)
    return out.select("doc_id", "n_sentences", F.array_join(F.transform("selected", lambda i: i.cast("string")), ",").alias("selected"))


@query("top_signals", f"""WITH {EV}, s AS (SELECT event_id, unnest([value / 50 - 1, (user_id % 7) / 7.0 - 0.5, (event_id % 11) / 11.0 - 0.5, (event_id % 13) / 13.0 - 0.6]::DOUBLE[]) AS v, unnest(['value', 'user', 'eleven', 'thirteen']) AS name FROM ev)
SELECT event_id, string_agg(name, ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(v), 9) DESC, name) AS k FROM s) WHERE k <= 2 GROUP BY 1""")
def _(spark, sf_dir):
    pair = lambda n, v: F.struct((-F.round(F.abs(v), 9)).alias("size"), F.lit(n).alias("name"))
    signals = F.array(pair("value", F.col("value") / 50 - 1), pair("user", (F.col("user_id") % 7) / 7.0 - 0.5), pair("eleven", (F.col("event_id") % 11) / 11.0 - 0.5), pair("thirteen", (F.col("event_id") % 13) / 13.0 - 0.6))
    top = F.transform(F.slice(F.array_sort(signals), 1, 2), lambda s: s["name"])
    return events(spark, sf_dir).select("event_id", F.array_join(top, ",").alias("top"))


@query("asof_context_page", f"WITH {EV} SELECT event_id, ts FROM ev WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY ts, event_id LIMIT 200")
def _(spark, sf_dir):
    return events(spark, sf_dir).filter("date BETWEEN DATE'2024-01-05' AND DATE'2024-01-20'").orderBy("ts", "event_id").limit(200).select("event_id", "ts")
