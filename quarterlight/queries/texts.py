"""Text, URL, page and rule functions over parts, pages, documents and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlight.functions import registered
from quarterlight.functions import game, rules, text, titles, urls
from quarterlight.operators import pages as page_ops
from quarterlight.queries.registry import query, table

# Keywords that fit the part table; the functions' defaults are for policy documents.
STANCES = {"tightening": ["steel", "small", "red"], "easing": ["brass", "large", "blue"], "hold": ["copper", "medium", "green"]}
INSTRUMENTS = {"policy_rate": ["brass"], "asset_purchase": ["steel", "tin"], "forward_guidance": ["nickel", "copper"]}
DOCS = {"economy": "minutes", "standard": "statement", "promo": "speech", "small": "report"}
ACTORS = [("CHN", "first", ["brand#1"]), ("GBR", "second", ["brand#2", " brand#31 "]), ("USA", "third", ["brand#3"])]
_n = lambda col, words: " + ".join(f"contains({col}, '{w}')::INTEGER" for w in words)
PART = "pt AS (SELECT p_partkey, lower(p_type || ' ' || p_name) AS t, p_size, p_brand FROM part)"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("t"), "p_size", "p_brand", "p_type")


@query("classify_stance", f"""WITH {PART}, c AS (SELECT p_partkey, {', '.join(f'{_n("t", w)} AS {k}' for k, w in STANCES.items())} FROM pt)
SELECT p_partkey, CASE WHEN greatest(tightening, easing, hold) = 0 THEN 'communication' WHEN tightening >= greatest(easing, hold) THEN 'tightening' WHEN easing >= hold THEN 'easing' ELSE 'hold' END AS stance FROM c""")
def _(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", rules.stance(F.col("t"), STANCES).alias("stance"))


@query("classify_instrument_action", f"""WITH {PART}, c AS (SELECT p_partkey, t, p_size, {', '.join(f'{_n("t", w)} AS {k}' for k, w in STANCES.items())} FROM pt),
s AS (SELECT *, CASE WHEN greatest(tightening, easing, hold) = 0 THEN 'communication' WHEN tightening >= greatest(easing, hold) THEN 'tightening' WHEN easing >= hold THEN 'easing' ELSE 'hold' END AS stance,
 CASE WHEN contains(t, 'brass') THEN 'policy_rate' WHEN contains(t, 'steel') OR contains(t, 'tin') THEN 'asset_purchase' WHEN contains(t, 'nickel') OR contains(t, 'copper') THEN 'forward_guidance' ELSE 'communication' END AS instrument,
 CASE WHEN p_size % 3 = 0 THEN 'speech' ELSE 'minutes' END AS doc_type FROM c),
a AS (SELECT *, CASE WHEN doc_type = 'speech' THEN 'signal' WHEN stance = 'tightening' THEN 'tighten' WHEN stance = 'easing' THEN 'ease' WHEN stance = 'hold' THEN 'hold' ELSE 'describe' END AS action FROM s)
SELECT p_partkey, instrument, action, instrument || '.' || action || '.' || stance AS strategy_key FROM a""")
def _(spark, sf_dir):
    doc_type = F.when(F.col("p_size") % 3 == 0, "speech").otherwise("minutes")
    df = parts(spark, sf_dir).withColumn("stance", rules.stance(F.col("t"), STANCES)).withColumn("instrument", rules.instrument(F.col("t"), INSTRUMENTS))
    return df.withColumn("action", rules.action(doc_type, F.col("stance"))).select("p_partkey", "instrument", "action", F.concat_ws(".", "instrument", "action", "stance").alias("strategy_key"))


@query("infer_doc_type", f"""WITH {PART} SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'operation' WHEN p_size % 9 = 1 THEN 'decision' WHEN contains(t, 'economy') THEN 'minutes' WHEN contains(t, 'standard') THEN 'statement' WHEN contains(t, 'promo') THEN 'speech' WHEN contains(t, 'small') THEN 'report' ELSE 'unknown' END AS doc_type FROM pt""")
def _(spark, sf_dir):
    source = F.when(F.col("p_size") % 9 == 0, "open_market_page").when(F.col("p_size") % 9 == 1, "key_rate_list").otherwise("other")
    return parts(spark, sf_dir).select("p_partkey", rules.doc_type(F.col("t"), source, DOCS).alias("doc_type"))


@query("infer_actor_country", """SELECT p_partkey, CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'CHN' WHEN contains(lower(p_brand), 'brand#2') OR lower(p_brand) = 'brand#31' THEN 'GBR' WHEN contains(lower(p_brand), 'brand#3') THEN 'USA' ELSE 'MULTI' END AS country,
CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'first' WHEN contains(lower(p_brand), 'brand#2') OR lower(p_brand) = 'brand#31' THEN 'second' WHEN contains(lower(p_brand), 'brand#3') THEN 'third' ELSE 'BIS' END AS actor FROM part""")
def _(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", rules.actor_country(F.col("p_brand"), ACTORS).alias("a")).select("p_partkey", "a.country", "a.actor")


@query("nav_title_filter", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_partkey <= 2) AND NOT regexp_matches(p_brand, '#[12]')")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    names = df.filter("p_partkey <= 2").select(F.lower("p_type").alias("name")).distinct()
    return df.join(names, F.lower("p_type") == F.col("name"), "left_anti").filter(~F.col("p_brand").rlike("#[12]")).select("p_partkey", "p_type")


URLS = """u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages)"""


@query("url_canonicalize", f"""WITH {URLS} SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://') THEN regexp_replace(bare, '^(https?://[^/?#]+)(\\?|$)', '\\1/\\2') END AS canonical FROM u""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("url_filter", r"""SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^https?://') AND len(url) - len(replace(url, '/', '')) <= 5 AND NOT regexp_matches(url, '\.html$') AND (regexp_matches(url, '/en/') OR regexp_matches(url, '/de/') OR page_id % 10 = 0)""")
def _(spark, sf_dir):
    depth = F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))
    return table(spark, sf_dir, "pages").filter(urls.url_allowed(F.col("url"), depth, 5, deny=[r"\.html$"], allow=["/en/", "/de/"], seed=F.col("page_id") % 10 == 0)).select("page_id", "url")


@query("html_strip_tags", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("text_md5"))


LINKS = r"""li AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS inn FROM pages),
ln AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN prefix(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END, '#.*$', '') AS target,
 trim(regexp_replace(regexp_replace(inn, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM li)"""


@query("html_extract_links", f"WITH {LINKS} SELECT page_id, target, text, count(*)::BIGINT AS n FROM ln WHERE text <> '' GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return page_ops.page_links(table(spark, sf_dir, "pages"), "page_id").groupBy("page_id", "target", "text").agg(F.count("*").alias("n"))


@query("html_list_items", r"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>\s*(.*?)\s*</li>', 1)) AS i FROM pages),
x AS (SELECT page_id, regexp_extract(i, '(?is)<a[^>]*\bhref\s*=\s*["'']([^"'']*)', 1) AS href, trim(regexp_replace(regexp_replace(i, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM i)
SELECT page_id, href, title, count(*)::BIGINT AS n FROM x WHERE href <> '' GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return page_ops.list_items(table(spark, sf_dir, "pages"), "page_id").groupBy("page_id", "href", "title").agg(F.count("*").alias("n"))


def _decoded(column: str) -> str:
    """SQL for the character references of the pages, decoded; those that a page's end or a title's cut leaves without a semicolon too."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("nbsp", " "), ("amp", "&")):
        column = f"regexp_replace({column}, '&{name}(;|$)', '{sign}', 'g')"
    return column


@query("html_extract_doc", rf"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1) || ' ' || regexp_extract(html, '(?is)<article>(.*?)(</article>|$)', 1) AS b FROM pages),
d AS (SELECT page_id, {_decoded('t')} AS t, {_decoded("regexp_replace(b, '<[^>]+>', ' ', 'g')")} AS b FROM p)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS title, md5(trim(regexp_replace(b, '\s+', ' ', 'g'))) AS text_md5, NULL::VARCHAR AS published FROM d""")
def _(spark, sf_dir):
    return page_ops.extract_documents(table(spark, sf_dir, "pages"), "page_id", parser="document_closed").select("page_id", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "published")


@query("parser_registry", r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t FROM pages),
d AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt(;|$)', '<', 'g'), '&gt(;|$)', '>', 'g'), '&quot(;|$)', '"', 'g'), '&amp(;|$)', '&', 'g') AS t FROM p)
SELECT page_id, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::INTEGER AS title_chars, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM d""")
def _(spark, sf_dir):
    registered.register(spark)
    return spark.sql("SELECT page_id, length(d.title) AS title_chars, md5(CAST(p.text AS BINARY)) AS plain FROM {pages}, LATERAL parse_page(html, 'document') d, LATERAL parse_page(html, 'plain') p", pages=table(spark, sf_dir, "pages"))


@query("html_rate_table", """WITH m AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2) SELECT entity, date, (n * 1.25)::DOUBLE AS rate, unnest(['table', 'chart']) AS origin FROM m""")
def _(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    format_ = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "d MMM yyyy")).otherwise(F.date_format("day", "dd.MM.yyyy"))
    named = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "yyyy d MMM")).otherwise(format_)
    row = F.concat(F.lit("<tr><td>"), named, F.lit("</td><td>"), F.format_number(F.col("n") * 1.25, 2), F.lit("</td></tr>"))
    point = F.struct(row.alias("row"), F.format_string('"%s"', F.date_format("day", "dd.MM.yyyy")).alias("day"), (F.col("n") * 1.25).cast("string").alias("rate"))
    list_ = lambda field: F.array_join(F.transform("points", lambda x: x[field]), ",")
    pages = days.groupBy("entity", F.year("day").alias("year")).agg(F.collect_list(point).alias("points")).select(
        "entity", F.concat(F.lit("<table>"), F.array_join("points.row", ""), F.lit("</table>")).alias("html"),
        F.concat(F.lit('<script>chart({"categories":['), list_("day"), F.lit('],"series":[{"name":"rate","data":['), list_("rate"), F.lit("]}]})</script>")).alias("script"),
    )
    return page_ops.rate_rows(pages, "entity").withColumn("origin", F.lit("table")).unionByName(page_ops.chart_rates(pages, "entity", "script").withColumn("origin", F.lit("chart")))


@query("decode_charset", "SELECT page_id, md5(html) AS text_md5 FROM pages")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    head = F.lit('<meta charset="iso-8859-1">')
    latin = (F.col("page_id") % 2 == 1) & F.col("html").rlike(r"^[\x00-\xFF]*$") & ~F.col("html").rlike(r"[\x80-\x9F]")
    raw = F.when(latin, F.encode(F.concat(head, "html"), "ISO-8859-1")).otherwise(F.col("html").cast("binary"))
    text_ = page_ops.decode_bytes(F.col("raw"))
    plain = F.when(F.col("latin"), F.expr("substr(t, 28)")).otherwise(F.col("t"))
    return df.withColumn("latin", latin).withColumn("raw", raw).withColumn("t", text_).select("page_id", F.md5(plain.cast("binary")).alias("text_md5"))


CRAWL = f"""WITH RECURSIVE {LINKS}, pg AS (SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]+)(\\?|$)', '\\1/\\2') AS url FROM pages),
ed AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]+)(\\?|$)', '\\1/\\2') AS url, regexp_replace(target, '^(https?://[^/?#]+)(\\?|$)', '\\1/\\2') AS target FROM ln JOIN (SELECT page_id AS p, url FROM pages) ON p = page_id WHERE text <> ''),
hs AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pg),
r(url, depth) AS (SELECT DISTINCT url, 0 FROM pg UNION SELECT ed.target, r.depth + 1 FROM r JOIN ed ON ed.url = r.url WHERE r.depth < 3 AND regexp_extract(ed.target, '^https?://([^/?#]*)', 1) IN (SELECT h FROM hs))
SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY 1"""


@query("crawl_frontier", CRAWL)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    edges = page_ops.page_links(pages, "url").select("url", "target")
    return page_ops.crawl(pages, edges, pages, 3)


@query("crawl_max_pages", f"SELECT * FROM ({CRAWL}) ORDER BY depth, url LIMIT 120")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    edges = page_ops.page_links(pages, "url").select("url", "target")
    return page_ops.crawl(pages, edges, pages, 3, max_pages=120)


DAY = "CAST(o_orderdate AS DATE)"


@query("infer_date", f"SELECT o_orderkey, {DAY} AS date FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) FROM orders WHERE o_orderkey % 4 = 3")
def _(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    said = F.when(k == 0, F.concat(F.lit("release "), F.date_format(d, "yyyyMMdd"), F.lit("a.htm"))).when(k == 1, F.concat(F.lit("on "), F.date_format(d, "yyyy/M/d"))).when(k == 2, F.concat(F.lit("held on "), F.date_format(d, "MMMM d, yyyy"))).otherwise("no date")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.infer_date(said, F.year(d)).alias("date"))


@query("extract_iso_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def _(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("due "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" and 2030-01-01"))).otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.iso_date(said).alias("iso"))


@query("normalize_title", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'FOMC minutes ' || strftime(o_orderdate, '%Y-%m-%d') || ' (PDF)' WHEN 1 THEN 'FOMC implementation note ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'FOMC statement ' || strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS title FROM orders""")
def _(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    title = F.when(k == 0, "pdf").when(k == 1, "Implementation note").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    url = F.when(k == 0, "http://x.org/FOMCminutes1.pdf").when(k < 3, "http://x.org/pressreleases/monetary2001.htm").otherwise("http://x.org/other")
    return table(spark, sf_dir, "orders").select("o_orderkey", titles.normalize_title(title, url, d).alias("title"))


@query("canonical_event_title", "SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title FROM part")
def _(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("  (pdf) "))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(": HTML"))).otherwise(F.concat(F.lit(" "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_title(said).alias("title"))


@query("document_rank", "SELECT page_id, CASE WHEN suffix(lower(url), '.html') OR suffix(lower(url), '.htm') THEN 0 WHEN suffix(lower(url), '.pdf') THEN 1 ELSE 2 END::INTEGER AS rank FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.document_rank(F.col("url")).alias("rank"))


@query("extract_magnitude_bp", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::INTEGER WHEN 1 THEN (round(l_tax * 100)::INTEGER) * 100 END::INTEGER AS bp FROM lineitem")
def _(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    points = F.format_string("raised by %d basis points", F.col("l_quantity").cast("int"))
    percent = F.format_string("cut of %d %% now", F.round(F.col("l_tax") * 100).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.magnitude_bp(F.when(k == 0, points).when(k == 1, percent).otherwise("kept")).alias("bp"))


@query("parse_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -round(o_totalprice, 2) END AS value FROM orders")
def _(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.concat(F.lit("about -"), F.format_number("o_totalprice", 2), F.lit(" per year")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_number(said).alias("value"))


@query("stable_event_id", "SELECT event_id, substr(sha1(event_id::VARCHAR || '|' || event_type || '|' || user_id::VARCHAR), 1, 16) AS stable FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.stable_id(F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string")).alias("stable"))


@query("text_hash", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"))


@query("tokenize", r"""SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INTEGER AS tokens, len(list_distinct(list_filter(string_split_regex(translate(lower(text), '_-', '  '), '\s+'), lambda w: length(w) > 2)))::INTEGER AS words FROM benchmark""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(text.tokens(F.col("text"))).alias("tokens"), F.size(text.token_set(F.col("text"))).alias("words"))


@query("split_sentences", r"""SELECT item_id, md5(array_to_string(list_filter(string_split(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), '|')) AS sentences FROM benchmark""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(text.sentences(F.col("text")), "|").cast("binary")).alias("sentences"))


@query("parse_kv_metrics", "SELECT event_id, (event_id % 50)::DOUBLE AS k, (user_id / 4.0)::DOUBLE AS score FROM events")
def _(spark, sf_dir):
    said = F.concat(F.lit("k=1 then score="), (F.col("user_id") / 4).cast("string"), F.lit("; k="), (F.col("event_id") % 50).cast("string"), F.lit(" end"))
    m = text.key_values(said)
    return table(spark, sf_dir, "events").select("event_id", m["k"].alias("k"), m["score"].alias("score"))


@query("metric_with_aliases", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN 2.0::DOUBLE * user_id ELSE 0.0::DOUBLE END AS risk FROM events")
def _(spark, sf_dir):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("energy_risk="), F.col("user_id").cast("string"))).when(k == 1, F.concat(F.lit("energy="), (F.col("user_id") * 2).cast("string"))).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", text.metric(text.key_values(said), ["energy_risk", "energy"]).alias("risk"))


@query("truncate_text", "SELECT doc_id, md5(substr(text, 1, 1200)) AS cut FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate(F.col("text"), 1200).cast("binary")).alias("cut"))


@query("taylor_rule", """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS infl, l_tax * 50 AS growth, l_quantity / 10 AS rate FROM lineitem), t AS (SELECT *, 2.5::DOUBLE + infl + 1.5::DOUBLE * (infl - 2) + 0.5::DOUBLE * (growth - 2) AS rule FROM b)
SELECT l_orderkey, l_linenumber, round(rule, 4) AS rule, round(rule - rate, 4) AS gap, CASE WHEN round(rule - rate, 4) > 1 THEN 'too_loose' WHEN round(rule - rate, 4) < -1 THEN 'too_tight' ELSE 'near_rule' END AS signal FROM t""")
def _(spark, sf_dir):
    rule = rules.taylor_rate(F.col("l_discount") * 100, F.col("l_tax") * 50)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(rule, 4).alias("rule"), F.round(rule - F.col("l_quantity") / 10, 4).alias("gap"))
    return df.withColumn("signal", rules.taylor_signal(F.col("gap")))


@query("ect_signal", "SELECT event_id, CASE WHEN value / 50 - 1 > 0.5 THEN 'above_equilibrium' WHEN value / 50 - 1 < -0.5 THEN 'below_equilibrium' ELSE 'near_equilibrium' END AS signal FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rules.ect_signal(F.col("value") / 50 - 1).alias("signal"))


BRIEF = """br AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS infl, (l_quantity - 25) / 10 AS gap, l_tax * 100 AS unemp, l_quantity / 50 AS energy, 0.4::DOUBLE AS cred, (l_discount - 0.05) * 20 AS ect, l_quantity / 60 AS hp, l_tax * 5 AS ep FROM lineitem),
be AS (SELECT *, least(1, greatest(0, 0.25::DOUBLE + 0.45::DOUBLE * (greatest(0, infl - 2) / 6) + 0.2::DOUBLE * (greatest(0, gap) / 4) + 0.1::DOUBLE * greatest(0, -ect / 5))) AS b1, least(1, greatest(0, 1 - (0.15::DOUBLE + 0.2::DOUBLE * greatest(0, (4.5::DOUBLE - unemp) / 3)))) AS b2,
 least(1, greatest(0, 0.2::DOUBLE + 0.15::DOUBLE * energy)) AS b3, least(1, greatest(0, 0.3::DOUBLE + 0.1::DOUBLE * (0.1::DOUBLE + 0.35::DOUBLE * (greatest(0, gap) / 4)))) AS b4, least(1, greatest(0, 0.25::DOUBLE + 0.1::DOUBLE * (gap / 4))) AS b5, least(1, greatest(0, cred + 0.25::DOUBLE * greatest(0, infl - 2) / 5)) AS b6 FROM br)
"""


def _brief(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    b = {"inflation": F.col("l_discount") * 100, "gap": (F.col("l_quantity") - 25) / 10, "unemployment": F.col("l_tax") * 100, "energy": F.col("l_quantity") / 50, "credibility": F.lit(0.4), "ect": (F.col("l_discount") - 0.05) * 20}
    return df, game.belief(b)


@query("belief_from_context", f"WITH {BRIEF} SELECT l_orderkey, l_linenumber, {', '.join(f'round(b{i}, 5) AS {k}' for i, k in enumerate(('inflation_persistence', 'labor_softening', 'energy_shock_risk', 'geopolitical_escalation', 'dollar_liquidity_pressure', 'policy_credibility_risk'), 1))} FROM be")
def _(spark, sf_dir):
    df, b = _brief(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", *[F.round(v, 5).alias(k) for k, v in b.items()])


@query("belief_from_text", """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, round(0.55::DOUBLE + 0.18::DOUBLE * (contains(t, 'inflation') OR contains(t, 'cpi'))::INTEGER, 4) AS inflation_persistence,
 round(0.28::DOUBLE + 0.14::DOUBLE * (contains(t, 'unemployment') OR contains(t, 'labor'))::INTEGER, 4) AS labor_softening,
 round(0.25::DOUBLE + 0.18::DOUBLE * (contains(t, 'energy') OR contains(t, 'oil'))::INTEGER, 4) AS energy_shock_risk,
 round(0.25::DOUBLE + 0.2::DOUBLE * (contains(t, 'sanction') OR contains(t, 'war') OR contains(t, 'geopolitical'))::INTEGER, 4) AS geopolitical_escalation,
 round(0.2::DOUBLE + 0.15::DOUBLE * (contains(t, 'liquidity') OR contains(t, 'dollar'))::INTEGER, 4) AS dollar_liquidity_pressure,
 round(0.45::DOUBLE + 0.2::DOUBLE * (contains(t, 'target') OR contains(t, 'credibility'))::INTEGER, 4) AS policy_credibility_risk FROM t""")
def _(spark, sf_dir):
    b = game.belief_from_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(v, 4).alias(k) for k, v in b.items()])


@query("fomc_path", f"""WITH {BRIEF}, s AS (SELECT *, greatest(0, least(0.95::DOUBLE, 0.02::DOUBLE + 0.55::DOUBLE * hp + 0.3::DOUBLE * b1 + 0.1::DOUBLE * b6 + 0.08::DOUBLE * b3 - 0.1::DOUBLE * b2)) AS h, greatest(0, least(0.6::DOUBLE, 0.02::DOUBLE + 0.35::DOUBLE * ep + 0.3::DOUBLE * b2 - 0.25::DOUBLE * b1 - 0.1::DOUBLE * b6)) AS c FROM be),
t AS (SELECT *, greatest(0, 1 - h - c) AS o FROM s) SELECT l_orderkey, l_linenumber, round(h / (h + o + c), 9) AS hike, round(o / (h + o + c), 9) AS hold, round(c / (h + o + c), 9) AS cut FROM t""")
def _(spark, sf_dir):
    df, b = _brief(spark, sf_dir)
    path = game.fomc_path(F.col("l_quantity") / 60, F.col("l_tax") * 5, b, digits=9)
    return df.select("l_orderkey", "l_linenumber", *[p.alias(n) for p, n in zip(path, ("hike", "hold", "cut"))])


@query("parse_override_value", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'null' WHEN 2 THEN 'float' WHEN 3 THEN 'int' ELSE 'string' END AS kind, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN NULL WHEN 2 THEN '0.5' WHEN 3 THEN user_id::VARCHAR ELSE event_type END AS value FROM events""")
def _(spark, sf_dir):
    k = F.col("event_id") % 5
    said = F.when(k == 0, "flag=True").when(k == 1, "x=none").when(k == 2, "y=0.5").when(k == 3, F.concat(F.lit("z="), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("s="), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", game.override_value(F.split(said, "=", 2)[1]).alias("o")).select("event_id", "o.kind", "o.value")


@query("clamp_answer", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5::DOUBLE ELSE round(greatest(0, least(1, value / 60)), 4) END AS answer FROM events")
def _(spark, sf_dir):
    said = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise((F.col("value") / 60).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", game.clamp_answer(said, 0.5).alias("answer"))


@query("strategy_vector_ops", """SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.7::DOUBLE * (l_quantity / 40) + 0.3::DOUBLE * (l_discount * 5))), 5) AS blended, round(greatest(abs(l_quantity / 40 - l_discount * 5), abs(l_tax * 5 - 0.2::DOUBLE)), 5) AS apart FROM lineitem""")
def _(spark, sf_dir):
    a, b = F.col("l_quantity") / 40, F.col("l_discount") * 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(rules.blend(a, b, 0.3), 5).alias("blended"), F.round(game.distance([a, F.col("l_tax") * 5], [b, F.lit(0.2)]), 5).alias("apart"))


@query("round_tree", "SELECT event_id, round(value / 7, 4) AS a, round(value / 11, 4) AS b FROM events")
def _(spark, sf_dir):
    m = F.transform_values(F.create_map(F.lit("a"), F.col("value") / 7, F.lit("b"), F.col("value") / 11), lambda _, v: F.round(v, 4))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("freshness_flag", "WITH x AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1) SELECT user_id, newest >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AS fresh FROM x")
def _(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"))
    return newest.select("user_id", (F.col("newest") >= F.expr("timestamp_ntz'2024-01-30 12:00:00' - interval 24 hours")).alias("fresh"))
