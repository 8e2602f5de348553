"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import html
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarterlight.llm import common, decontaminate, gru, html_text, language_id, lm_score, mixing, near_dup, nearest, token_files, url_filter, warc
from quarterlight.llm.queries import QUERIES
from quarterlight.llm.words import WordHash, alnum_words, lots, space_words, space_words_together

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in common.table(spark, sf_dir, "documents").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and very long texts, repeated rows, and columns whose names operators use."""
    rows = [(1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0), (4, "12345 !!", "de", "b", 8),
            (None, "a text without an id", "en", "b", 3), (5, LONG, "en", "b", len(LONG)), (6, LONG, "de", None, len(LONG))]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("mine") for c in ("score", "rejected", "spans", "items", "size", "_h", "_m", "tokens", "class_id", "key", "start", "part")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 mixing


def test_mix_targets_and_taken(spark, sf_dir, documents):
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in QUERIES["op1_mix_sources"](spark, sf_dir).collect():
        d = documents[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        by[d.source][0] += r["size"]
        by[d.source][1] += r.taken
        by[d.source][2] = r.target
    names = sorted(by)
    weight, open_, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, set(names), 1.5 * sum(x[0] for x in by.values()), {}
    while full := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * by[s][0]]:
        target |= {s: 2.0 * by[s][0] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    sizes, cuts = mixing.mix_plan(common.table(spark, sf_dir, "documents"))
    edge = collections.Counter()  # words of the bucket at which a source is cut
    for r in mixing.with_copies(sizes, cuts).filter((mixing._prefix(mixing.LEVELS) - F.col("_m.cut")).isin(-1, 0)).collect():
        edge[r.source] += r["size"]
    for s in names:
        assert by[s][2] == pytest.approx(target[s]) and abs(by[s][1] - target[s]) <= edge[s] + 1e-6 * target[s]


@pytest.mark.parametrize("n", [1, 2, 4, 6, 10])
def test_mix_of_equal_documents_meets_the_target_exactly(spark, n):
    rows = [(i, " ".join(["w"] * 10), s) for s in ("a", None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = collections.Counter(r.source for r in mixing.mix_documents(docs, weights=(1, 1)).collect())
    assert {s: 10 * k for s, k in taken.items()} == {"a": 15 * n // 10 * 10 + (10 if n == 1 else 0), None: 15 * n // 10 * 10 + (10 if n == 1 else 0)}


def test_mix_deals_rows_without_a_key(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "a") for i in range(200)], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs).count() == 300 and mixing.mix_documents(docs, share=0.5).count() == 100


def test_mix_reruns_agree_and_odd_rows(spark, sf_dir, odd, none):
    one = sorted(QUERIES["op1_mix_sources"](spark, sf_dir).collect())
    assert one == sorted(QUERIES["op1_mix_sources"](spark, sf_dir).collect())
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns and {r._h for r in out.collect()} <= {"mine"}
    assert mixing.mix_documents(none).count() == 0


def test_mix_budgets_are_nested(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    less, more = ({r.doc_id for r in mixing.mix_documents(docs, share=s, most=1.0).collect()} for s in (0.3, 0.6))
    assert less < more


# 2 html


def test_html_against_a_plain_cut(spark, sf_dir):
    pages = {r.page_id: r for r in common.table(spark, sf_dir, "pages").collect()}
    for r in QUERIES["op2_html_text"](spark, sf_dir).collect():
        inner = re.split("<article>|</article>", pages[r.page_id].html)[1]
        found = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inner)]
        assert r.text == "\n".join(b for b in found if b) and r.n_chars == len(r.text)


ARTICLE = """<body><header class="site">Site</header><div class="sidebar"><p>Aside of quite a few words that go on and on and on for a while</div><main><h1>A &amp; B</h1><p>First&nbsp;para
 graph with a <a href=x>link</a> in it.<div class="cookie-notice">We use cookies to see what you read and when you read it</div><p>Tiny.<form><p>Your name</form><!-- <p>not --><script>if (a < b) x("</p>")</script></main>
<section id="comments"><p>Reader comment of several words which is long enough to read as prose</p></section><footer>Bottom</footer>"""


def test_html_odd_pages(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (3, "u", ""), (4, "u", "<article>open <b>never closed"), (5, "u", "<p>a<!-- no end"), (6, "u", "<article>" + "<p>word</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "blocks": F.lit("mine")})
    out = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert out[1] == "A & B\nFirst para graph with a link in it.\nTiny." and out[2] == out[3] == "" and out[4] == "open never closed" and out[6].count("\n") == 19_999
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_wrappers_and_unclosed_elements(spark):
    story = "<h1>Title</h1><p>" + "some words of the story that go on for a while " * 3 + "</p><p>Tiny.</p>"
    want = "Title\n" + " ".join(("some words of the story that go on for a while " * 3).split()) + "\nTiny."
    around = "<div class=related><article><p>Another story to read</p></article></div>"
    pages = [
        f'<html class="no-ads"><body class="has-sidebar"><article>{story}</article></body></html>', f'<div class="layout no-ads"><article>{story}</article>{around}</div>',
        f'<article class="post share">{story}<div class=share>Share it</div></article>{around}', f'<main id="search"><div class="layout no-sidebar"><article>{story}</article></div></main>',
        f"<article><datalist><option value=a></datalist>{story}<form><select><option>x</option></select></form></article>",
        f"<article><div><svg><path d=x></div>{story}</article>", f"<article><div><object data=x></div>{story}</article>", f"<article><select><option>a<option>b</select>{story}</article>",
    ]
    out = html_text.main_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert {r.page_id: r.text for r in out} == dict.fromkeys(range(len(pages)), want)


def test_html_forms_readers_and_notices(spark):
    story = "".join(f"<p>The story goes on in paragraph number {i} with a good many words so that it reads as prose and not as a menu of links.</p>" for i in range(3))
    want = "\n".join(f"The story goes on in paragraph number {i} with a good many words so that it reads as prose and not as a menu of links." for i in range(3))
    readers = "".join(f"<p>Reader {i} says that this was a very good read and that there should be more of it in the paper next week, thanks.</p>" for i in range(6))
    pages = [
        *(f"<form id=aspnetForm>{x}</form>" for x in (f"<article>{story}</article>", f"<main>{story}</main>", f"<div>{story}</div>")),
        f"<article>{story}</article><article class='comment-body'>{readers}</article>", f"<article>{story}<article class='comment-body'>{readers}</article></article>",
        *(f"<article>{story}</article><div {x}>{readers}</div>" for x in ("class=discussion", "id=responses", "class=kommentare", "id=onetrust-consent-sdk")),
        f"<main>{story}<div class=side-column>{readers}</div></main>", f"<article>{story}</article><div>\u00a9 2024 Example. All rights reserved.</div>",
        f"<article>{story}<div class=tags><a href=/a>one</a> <a href=/b>two</a></div></article>", f"<div>{story}</div><div class=comments>{readers}{readers}</div>",
    ]
    out = html_text.main_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert {r.page_id: r.text for r in out} == dict.fromkeys(range(len(pages)), want)


def test_html_tree_weighs_words_and_neighbours(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    fit = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=1, maxBins=64, seed=1).fit(html_text.labelled_table(spark).coalesce(1))
    weight = dict(zip(html_text.FEATURES, fit.featureImportances.toArray()))
    assert weight["aside"] < 0.5 and weight["words"] > 0 and weight["density"] > 0.1
    assert sum(weight[c] for c in ("words_before", "density_before", "words_after", "density_after")) > 0.1


def test_html_names_are_no_judge_of_the_text(spark):
    story = "".join(f"<p>{x} some words of the story that go on for a while and then a little longer so that it reads as prose</p>" for x in "ABCD")
    want = "\n".join(f"{x} some words of the story that go on for a while and then a little longer so that it reads as prose" for x in "ABCD")
    reader = "<p>Reader comment of several words which is long enough to read as prose and goes on for quite some time</p>"
    pages = [
        f'<body class="has-sidebar"><div>{story}</div></body>', f'<body class="home search-enabled"><div>{story}</div></body>', f'<article class="post has-comments">{story}</article>',
        f'<div class="social-science">{story}</div>', f'<div class="research search-paper">{story}</div>', f'<div class="comments">{story}</div>',
        story.replace("<p>A", '<p title="the hidden cost of it">A'), story.replace("<p>B", '<p data-style="display:none" class="hidden-figures">B'),
        *(f"<article>{story}</article><div {name}>{reader}</div>" for name in ("class=commentlist", "class='side-bar'", "class='cookiebar big'", "id=commentThread", "role=complementary", "style='display: none'", "hidden", "class=user-comments-2")),
        f"<div>{story}</div><div class=commentlist>{reader}</div>", f"<div class=sideBar>{reader}</div><div>{story}</div>",
    ]
    out = html_text.main_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("blocks", F.lit("mine"))).collect()
    assert {r.page_id: r.text for r in out} == dict.fromkeys(range(len(pages)), want) and {r.blocks for r in out} == {"mine"}


def test_html_density_and_neighbours_decide_without_names(spark):
    prose = "".join(f"<p>Paragraph {i} of the story that goes on for a while and then a little longer so that it reads as prose</p>" for i in range(4))
    links = "".join(f"<div><a href=/{i}>link {i} to more</a></div>" for i in range(6))
    out = html_text.main_text(spark.createDataFrame([(1, f"<div>{links}</div><div>{prose}</div><div>{links}</div>")], "page_id long, html string")).first().text
    assert out.count("Paragraph") == 4 and "link" not in out
    feature = dict(zip(html_text.FEATURES, range(len(html_text.FEATURES))))
    rows = [x for page in html_text.LABELLED for x in html_text.features(html_text.blocks(page))]
    assert len(rows) > 120 and len({x[feature["density"]] for x in rows}) > 3


# 3 language


def test_language_held_out_accuracy(spark, sf_dir, documents):
    rows = QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    right = [r.lang_pred == documents[r.doc_id].lang for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.9


def test_language_odd_rows(spark, odd, none, documents):
    learned = language_id.learn_dictionaries(spark.createDataFrame([(d.doc_id, d.text, d.lang) for d in documents.values()], "doc_id long, text string, lang string"))
    out = {(r.doc_id, r.text): r for r in language_id.identify_languages(odd, learned).collect()}
    assert all(out[k].lang_pred == "und" and out[k].rejected and out[k].score == 0 for k in ((2, None), (3, ""), (4, "12345 !!")))
    assert language_id.keep_identified(odd).columns == odd.columns
    assert language_id.learn_dictionaries(none) == {} and language_id.keep_identified(none).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(odd, {}).collect()} == {"und"}


def test_language_starts_no_python_workers_to_learn(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents")
    learned = language_id.learn_dictionaries(docs)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert learned and language_id.learn_dictionaries(docs) == learned


def test_language_learns_from_distinct_texts(spark):
    rng = np.random.default_rng(2)
    say = lambda a, n: " ".join(f"{a}{i}" for i in rng.integers(0, 5000, n))
    few, many, rare = [say("few", 600) for _ in range(10)], [say("many", 600) for _ in range(130)], [say("rare", 400)]
    copies = [x for x in many for _ in range(150)]  # any group of copies fills the sample
    df = spark.createDataFrame([(x, "aa") for x in few for _ in range(1000)] + [(x, "bb") for x in copies] + [(x, "cc") for x in rare], "text string, lang string")
    learned = language_id.learn_dictionaries(df)
    assert sorted(learned) == ["aa", "bb", "cc"]
    assert all(x[max(0, len(x) - 4000) : 4000].encode() in learned["aa"] for x in few) and learned["cc"] == rare[0].encode()
    assert len(learned["bb"]) > 100_000 and sum(x[2000:2100].encode() in learned["bb"] for x in many) > 20
    assert sum(x[:300].encode() not in learned["aa"] for x in few if len(x) > 4100) > 0  # stretches don't all begin where texts do
    found = language_id.identify_languages(spark.createDataFrame([(few[3],), (many[5],), (rare[0][:900],)], "text string"), learned).collect()
    assert [r.lang_pred for r in found] == ["aa", "bb", "cc"]


# 4 warc


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 100_000)
    body = "<p>a\r\n\r\nWARC/1.1\r\n</p> ü"
    rows = [(1, "http://x/1", body), (2, None, body), (3, "http://x/\r\n3", None), (4, "http://x/4", ""), (-5, "http://x/5", "z" * 200_000), (None, "http://x/6", "a"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_digest": F.lit("mine"), "fields": F.lit("mine")})
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    captures = {r.metadata.fields.split()[1] if "pageId: \r" not in r.metadata.fields else r.main.uri: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert len(captures) == 7 and all(r.main and r.request and r.metadata for r in captures.values())
    of = lambda i: captures[str(i)].main
    assert bytes(of(2).payload) == body.encode() and of(2).type == "response"
    assert of(1).type == "revisit" and of(1).refers_to == of(2).record_id and of(1).digest == of(2).digest
    assert of(3).type == "revisit" and of(4).type == "response" and len(of(-5).payload) == 200_000 and of(3).refers_to == of("").refers_to == of(4).record_id
    assert of(4).digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and bytes(of("http://x/6").payload) == b"a"
    # other tools read the files as one gzip stream of a member a record
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "warc").glob("part-*")))
    assert data.count(b"WARC-Type: ") == 21 and sum(1 for f in (tmp_path / "warc").glob("part-*") for _ in warc.members(memoryview(f.read_bytes()))) == 21


def test_warc_keeps_repeated_and_null_ids(spark, monkeypatch):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (None, "u", "same"), (None, "u", "none"), (None, "u", "none"), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "table", lambda *_: pages)
    for few in (common.BROADCAST_ROWS, 0):  # originals broadcast, originals shuffled
        monkeypatch.setattr(warc, "small", lambda df, few=few: common.small(df, limit=few))
        got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op4_warc(spark, "").collect())
        assert got == collections.Counter({(1, 4, "response", None): 1, (1, 4, "revisit", 1): 1, (1, 5, "response", None): 1, (None, 4, "revisit", 1): 1, (None, 4, "response", None): 1, (None, 4, "revisit", None): 1, (7, 0, "response", None): 1})


def test_warc_members_end_in_a_zero_byte():
    long = "x" * (1 << 24)  # its length's highest byte is one
    batch = warc.pa.RecordBatch.from_arrays([warc.pa.array([x]) for x in ("a", long, "b")], names=["request", "main", "metadata"])
    value = next(warc._members(iter([batch]))).column(0)[0].as_py() + b"\0"
    assert [len(x) for x in warc.members(memoryview(value))] == [5, (1 << 24) + 4, 5] and len(gzip.decompress(value)) == (1 << 24) + 14


def test_warc_threshold_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    for name, rows in (("some", pages), ("none", pages.limit(0))):
        warc.write_archives(rows, f"file://{tmp_path}/{name}", least=4)
    found = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/some")).collect()
    assert sorted(r.main.type for r in found) == ["response", "response", "response", "revisit"]
    assert warc.assemble(warc.read_records(spark, f"file://{tmp_path}/none")).count() == 0


# 5 decontamination


def hits(text, items):
    """Plain version: positions inside an occurrence of a window, and the items."""
    words, found, which = alnum_words(text), set(), set()
    for item, t in items:
        own = alnum_words(t)
        n = min(10, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    found.update(range(i, i + n))
                    which.add(item)
    return len(words), len(found), sorted(which)


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate([25, 10, 11, 3, 1, 0, 40, 12])] + [(90, "a a a a a a a a a a a"), (91, None), (1, None)]
    texts = [say(60) + " " + items[int(rng.integers(8))][1] + ", " + say(20) for _ in range(60)] + [None, "", "!!", "a " * 500, items[0][1].upper(), "W1-w2"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for held in (decontaminate.INDEXED_BYTES, 0):  # an index in every task, a join of fingerprints
        monkeypatch.setattr(decontaminate, "INDEXED_BYTES", held)
        out = decontaminate.find_benchmark(docs, bench).collect()
        assert len(out) == len(texts)
        for r in out:
            assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == hits(texts[r.doc_id], items)
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(7, "cat sat on the mat and looked at the dog")], "item_id long, text string")
    kept = decontaminate.clean_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.clean_documents(odd, bench.limit(0)).count() == odd.count() and decontaminate.clean_documents(none, bench).count() == 0


def test_decontamination_ways_agree_on_null_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 40, n))
    items = [(i, say(20)) for i in range(12)] + [(None, say(15)), (3, "w1 w2 w3")]
    rows = [(None, "x " + items[0][1]), (None, "clean"), (5, items[1][1] + " y " + items[7][1]), (5, items[2][1]), (5, "clean too"), (6, None), (7, "q " + items[12][1]), (7, "w1 W2, w3"), (7, "w1 W2, w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_row", "row", "prints")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, t, "mine", *(lambda n, hit, which: (n, hit, sorted(x for x in which if x is not None)))(*hits(t, [(-1 if i is None else i, x) for i, x in items]))) for i, t in rows]
    want = sorted(((*w[:5], [x for x in w[5] if x >= 0]) for w in want), key=str)
    for held in (decontaminate.INDEXED_BYTES, 0):
        monkeypatch.setattr(decontaminate, "INDEXED_BYTES", held)
        got = [(r.doc_id, r.text, r["_row"], r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in decontaminate.find_benchmark(docs, bench).collect()]
        assert sorted(got, key=str) == want
        assert decontaminate.find_benchmark(docs.limit(0), bench).count() == 0 and decontaminate.clean_documents(docs, bench.limit(0)).count() == len(rows)


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(1, 9, 10).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(1, 9, 17).astype(np.uint64), shared, rng.integers(1, 9, 9).astype(np.uint64)]) for _ in range(2))
        kept = [set(g[decontaminate.winnow(g, 6)].tolist()) for g in (decontaminate.gram_hashes(x, 5) for x in (a, b))]
        assert kept[0] & kept[1] & set(decontaminate.gram_hashes(shared, 5).tolist())


def test_repeated_windows_make_no_products(spark):
    """Windows that come often in items and in a document: linear in both, and the same by index and by join."""
    import time
    import tracemalloc

    index = decontaminate.BenchmarkIndex([(0, "a " * 3000), (1, "a " * 2500), (2, "b a " * 40)])
    tracemalloc.start()
    began = time.time()
    [(n, spans, items)] = decontaminate._scan(index, ["a " * 60_000])
    assert (n, spans, items) == (60_000, [(0, 60_000)], [0, 1]) and time.time() - began < 5 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(i, f"own{i} {shared} end{i}") for i in range(50)] + [(60, "a " * 40), (61, "x y"), (62, "x y"), (63, "q")]
    texts = [f"{shared} {shared} and x y", "a " * 300, "x y x y q " * 20, "nothing here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in df.collect())
    by_index, by_join = rows(decontaminate._by_index(docs, bench)), rows(decontaminate._by_join(docs, bench))
    assert by_index == by_join and by_index[0][3] == [*range(50), 61, 62] and by_index[2][2] == [(0, 100)]
    assert [(n, sum(b - a for a, b in spans), found) for _, n, spans, found in by_index] == [hits(t, items) for t in texts]


# 6 token files


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, documents, tmp_path, encoding):
    from tokenizers import Tokenizer

    texts = {d.doc_id: d.text for d in documents.values()} | {-5: None, 10_000: "", 10_001: "A\u0301 e\u0301\u00a0x\tTab's <|endoftext|>  ß\u2003İ\u0130", 10_002: LONG}
    path = f"file://{tmp_path}/{encoding}"
    token_files.write_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, encoding=encoding)
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path(token_files.TOKENIZER))
    rows, at = {r.doc_id: r for r in token_files.read_digests(spark, path).collect()}, 0
    starts = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_starts(spark, path).collect()}
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and starts[i] == (at, len(ids))
        at += len(ids)
    for file in (tmp_path / encoding).glob("part-*"):
        meta = pq.ParquetFile(file).metadata
        if meta.num_rows:
            column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("tokens"))
            assert column.has_offset_index and any(("DICTIONARY" if encoding == "dictionary" else "DELTA") in e for e in column.encodings)


def split_ids(ids, edges):
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


def test_token_encoder_equals_the_library(documents):
    encoder = token_files.Encoder(token_files.TOKENIZER)
    assert encoder.by_word
    texts = ["A\u0301 E\u0301x\tTab's 'S 'LL don'T <|endoftext|>\u0130", "\u00c0\u00c9\u00d7\u00f7\u00aa \u00b5 \u0085 x\x1cy \x0by z\x7f\u00a0q", "\u01c6 \u0391\u03a3 \u03a3 \u01f0 J\u030c H\u0331 h\u0331", "\u00ff\u0178\r\nA1\u00b23\u00bdx", "a \u0301b", "a\u2026\u00bbb \u00abc\u00bb 'LL", "<|startoftext|>ab <| endoftext|>", "\ufb01 \ufdfa \U0001d4b3 \U0001d7d9 \U0001f44d\U0001f3fd", "", "\n\n  \n", "x|y | z||", LONG]
    texts += [d.text for d in documents.values() if d.text]
    texts += [a + b for a in ("\u00e9", "e\u0301", "X", "1", "'", "\u00b7") for b in ("s", "'s", " 's", "\u0301", "\u0323\u0302", "\u00c5", "!\u00a1")]
    want = [f.ids for f in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new and remembered pieces
        assert split_ids(*encoder.encode(pa.array(texts))) == want


def test_token_encoder_forgets_and_takes_other_tokenizers(documents, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 50)
    for name in (token_files.TOKENIZER, "byte_bpe_50k.json"):
        encoder = token_files.Encoder(name)
        for d in list(documents.values())[:20]:
            words = len(set((d.text or "").split(" ")))
            assert split_ids(*encoder.encode(pa.array([d.text or ""]))) == [encoder.tokenizer.encode(d.text or "", add_special_tokens=False).ids]
            assert len(encoder.known_words) <= 25 + words
            held = len(encoder.known_pieces)
            assert held <= max(50, len(set(re.findall(r"\w+|[^\w\s]+", (d.text or "").lower()))) * 2)


def test_token_files_odd_rows(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path(token_files.TOKENIZER))
    rows = [(1, "ab " * n) for n in (9, 0, 5, 3, 3, 7)] + [(None, "x y"), (None, None), (0, "z"), (2, "end")]
    path = f"file://{tmp_path}/repeated"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    # where the ids stand in the files, taken one after the other
    stored = [r for file in sorted((tmp_path / "repeated").glob("part-*")) for r in pq.read_table(file).to_pylist()]
    at, want = 0, []
    for r in sorted(stored, key=lambda r: r["part"]):  # a stable sort: rows of a part stay as they are written
        want.append((r["doc_id"], at, r["n_tokens"], zlib.crc32(np.array(r["tokens"], "<u4").tobytes())))
        at += r["n_tokens"]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want and [r[0] for r in want] == [None, None, 0, 1, 1, 1, 1, 1, 1, 2]
    texts = sorted((i is not None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["tokens"]) for r in stored) == texts
    assert sorted((r.start, r.n_tokens) for r in token_files.read_starts(spark, path).collect()) == [r[1:3] for r in want]
    ends = sorted((r.start, r.n_tokens) for r in token_files.token_digests(odd).collect())
    assert len(ends) == odd.count() and ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert token_files.token_digests(none).count() == 0


def test_token_files_read_a_range_skips_pages(spark, tmp_path):
    path = f"file://{tmp_path}/range"
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"), F.repeat(F.lit("more of it "), 20)).alias("text"))
    token_files.write_tokens(docs, path, row_group=1 << 16, page=1 << 12, page_rows=100)
    every = {r.doc_id: r for r in token_files.read_digests(spark, path).collect()}
    found = token_files.read_range(spark, path, 3000, 3049)
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000, 3050))
    assert all((r.start, r.n_tokens, zlib.crc32(np.array(r.tokens, "<u4").tobytes())) == (every[r.doc_id].start, len(r.tokens), every[r.doc_id].ids_crc32) for r in rows)
    assert scanned_rows(found) < 600  # of 6000


def scanned_rows(df):
    """Rows that the plan's scan of tokens gave, after row groups and pages were skipped."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if "Scan" in node.nodeName() and "tokens" in node.toString().split("ReadSchema")[-1]:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_tokens_of_many_rows_under_one_id_are_dealt(spark):
    """Every second id is null: the nulls don't meet in one task, and places still follow each other."""
    rows = [(None if i % 2 else i, f"text number {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = common.new_path(spark, "tokens")
        token_files.write_tokens(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path)
    parts = [r.n for r in files.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(parts) > 1 and max(parts) < 2000
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read_digests(spark, path).collect())
    assert [s for s, *_ in got] == list(np.cumsum([0] + [n for _, n, _ in got])[:-1])
    ids = [-1 if i is None else i for *_, i in got]
    assert ids == sorted(ids) and ids.count(-1) == 2000


# 7 urls


def test_url_rules(spark):
    urls = {1: "https://WWW.Example.com/en/74?x#y", 2: "http://a.com/en/", 3: "http://a.com/en", 4: "x://b.net/de/8", 5: "http://example.net/de/81/9", 6: "http://example.org/es/?q", 7: None, 8: "no scheme", 9: "http://notcom/en/", 10: "://com/en/", 11: "http://a.com", 12: "http://com.org/es/1"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumns({"rule": F.lit("mine"), "host": F.lit("mine")})
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    trie = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert trie[1] == ("www.example.com", "/en/74", "example.com/en/7", "allow") and trie[2][2:] == ("com/en/", "block") and trie[3][2:] == (None, "allow")
    assert trie[4][2:] == ("net/de/", "block") and trie[5][2:] == ("example.net/de/8", "block") and trie[6][2:] == ("org/es/", "block")
    assert trie[7] == ("", "", None, "allow") == trie[8] and trie[9][2:] == (None, "allow") and trie[10][2:] == ("com/en/", "block") and trie[12][2:] == ("org/es/", "block")
    before, url_filter.TRIE_RULES = url_filter.TRIE_RULES, 2
    try:
        joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    finally:
        url_filter.TRIE_RULES = before
    assert joined == trie and url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_query_has_the_contract_rules(spark, tmp_path):
    urls = {1: "http://b.net/de/8", 2: "http://net/de/", 3: "http://www.example.net/de/81", 4: "http://www.example.net/de/7", 5: "http://a.com/en/7", 6: "http://example.com/en/7", 7: "http://a.org/es/1", 8: "http://a.net/en/1"}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()}
    net = ("net/de/", "allow")
    assert got == {1: net, 2: net, 3: ("example.net/de/8", "block"), 4: net, 5: ("com/en/", "block"), 6: ("example.com/en/7", "allow"), 7: ("org/es/", "block"), 8: (None, "allow")}


@pytest.mark.parametrize("turn", [1, -1])
def test_url_rules_that_conflict_are_judged_alike_both_ways(spark, monkeypatch, turn):
    urls = {1: "http://a.com/x", 2: "http://b.com/xy/z", 3: "http://c.com/q", 4: "http://d.com/xy", 5: "http://e.com", 6: None}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    rules = [("allow", "a.com", ""), ("block", "a.com", None), ("block", "b.com", "/x"), ("allow", "b.com", "/x"), ("block", "c.com", "q"), ("allow", "d.com", "/x"), ("block", "d.com", "/xy"), ("block", "", "/xy/z"), ("block", "e.com", "/")][::turn]
    want = {1: ("a.com", "block"), 2: ("b.com/x", "block"), 3: (None, "allow"), 4: ("d.com/xy", "block"), 5: (None, "allow"), 6: (None, "allow")}
    for most in (100, 2):
        monkeypatch.setattr(url_filter, "TRIE_RULES", most)
        out = url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
        assert {r.page_id: (r.rule, r.verdict) for r in out} == want


# 8 nearest


def brute(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (m * good[q]).sum(axis=1)
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(200)]  # a vector that many rows share
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [None] + [1.0] * 15), (3003, [float("nan")] * 16), (3004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = collections.defaultdict(list)
    for r in sorted(nearest.nearest(df, cell=300).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    want = brute([(9999 if i is None else i, v) for i, v in rows], 20, 20)
    want = {q: [(None if i == 9999 else i, s) for i, s in found] for q, found in want.items()}
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert got[2000] == [(i, pytest.approx(s)) for i, s in want[2000]]  # ties to the smaller id


@pytest.mark.parametrize("cell", [300, 2000])
def test_nearest_recall_with_several_cells_and_chunks(spark, monkeypatch, cell):
    monkeypatch.setattr(nearest, "QUERIES", 40)
    monkeypatch.setattr(nearest, "BLOCK", 200)
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 24)) * rng.uniform(0.5, 2, (4000, 1)))]
    got = collections.defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=cell).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert set(got) == set(want) and all(sorted(x)[0][0] == 1 and len(x) == 20 for x in got.values())
    assert np.mean([len({x[1] for x in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    scores = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(s == scores[q, i] for q, found in got.items() for _, i, s in found if (q, i) in scores)


def test_nearest_takes_every_row(spark):
    """Repeated and null ids are rows of their own, other lengths are searched apart; all candidates where there are few."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((9, 6))
    rows = [(20, v[0].tolist()), (20, v[1].tolist()), (1, v[2].tolist()), (None, v[3].tolist()), (None, v[2].tolist())]
    rows += [(40, [1.0, 2.0]), (41, [3.0, 0.5]), (60, [4.0]), (80, None), (100, []), (0, [0.0] * 6), (21, v[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("mine"))
    got = sorted((tuple(r) for r in nearest.nearest(df).collect()), key=str)
    want = []
    for i, (q, a) in enumerate(rows):
        if q is None or q % 20 or not a or not any(a):
            continue
        found = sorted((-float(np.sum(np.array(a) * b)), 1 << 40 if c is None else c) for j, (c, b) in enumerate(rows) if j != i and b and any(b) and len(b) == len(a))
        want += [(q, k + 1, None if c == 1 << 40 else c, -s) for k, (s, c) in enumerate(found)]
    want.sort(key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want]) and len(want) == 11


def test_nearest_visits_cells_in_rounds(spark, monkeypatch):
    """Clusters in many cells: recall as with one cell, and the copies of a query that are sent stay far below the number of cells."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 10)) * 6
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) / 10
    rows = [(i, (centres[i % 40] + 0.3 * rng.standard_normal(10)).tolist()) for i in range(2400)]
    sent, real = [], nearest.in_chunks
    monkeypatch.setattr(nearest, "in_chunks", lambda routed, chunks: (sent.append(routed.count()), real(routed, chunks))[1])
    got = collections.defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=60).collect():
        got[r.query_id].append(r.vec_id)
    want = brute(rows, 20, 20)
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert sent[0] == 120 and sum(sent) < 0.5 * 120 * 40


def test_nearest_blocks_go_to_the_chunks_of_their_cell_alone(spark, monkeypatch):
    """Rows sent grow with the data: twice the vectors and queries in twice the cells are twice the rows."""
    monkeypatch.setattr(nearest, "QUERIES", 10)
    sent = []
    for n in (1000, 2000):
        blocks = spark.range(n).select("id", (F.col("id") % (n // 100)).alias("cell"))
        routed = blocks.filter("id % 4 = 0")
        chunks = nearest.chunks_by_cell(routed)
        held, asked = nearest.for_chunks(blocks, chunks), nearest.in_chunks(routed, chunks)
        assert asked.count() == n // 4 and held.select("cell", "chunk").distinct().exceptAll(asked.select("cell", "chunk").distinct()).count() <= n // 50
        assert held.filter("cell % 4 > 0").join(routed.select("cell").distinct(), "cell", "left_anti").count() == 0
        sent.append(held.count())
    assert sent[1] == 2 * sent[0]


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [3.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in sorted(nearest.nearest(df).collect(), key=lambda r: r.rank)] == [(1, 2, 3.0), (2, 1, 0.5)]
    assert nearest.nearest(df.limit(0)).count() == 0


# 9 language model


def test_lm_counts_are_exact_and_score_beats_base(spark, sf_dir, documents):
    counts = collections.Counter()
    for d in documents.values():
        if zlib.crc32(str(d.doc_id).encode()) % 7 != 2:
            counts.update(space_words(d.text))
            counts[b"\n"] += 1
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op9_lm_score"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        words = [*space_words(documents[r.doc_id].text), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert np.isfinite(r.score)
    apart = [r for r in rows if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_lm_held_out_score_beats_base_and_untrained_start(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    learned = docs.filter(~lm_score.held_out(F.col("doc_id"))).select("text")
    corpus = lm_score.Corpus(common.save(lm_score.token_counts(learned), "counts"))
    apart = docs.filter(lm_score.held_out(F.col("doc_id")))
    total = lambda params: lm_score.score_documents(apart, corpus, params).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    trained, start = total(lm_score.train(learned, corpus)), total(gru.pack(gru.start(corpus.vocabulary(), lm_score.HIDDEN)))
    assert (trained[0] - start[0]) / trained[2] > 0.1 and (trained[0] - trained[1]) / trained[2] > 0.1


def test_lm_lists_words_by_a_histogram(spark, monkeypatch):
    counts = {f"w{i}".encode(): n for i, n in enumerate([900, 500, 70, 70, 70, 9, 9, 3, 3, 3, 1])} | {b"\n": 40}
    df = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    for listed, want in ((4, 2), (6, 5), (12, 11), (100, 11), (1, 0)):
        monkeypatch.setattr(lm_score, "LISTED", listed)
        corpus = lm_score.Corpus(df)
        assert len(corpus.words) == want + 1 and (corpus.tokens, corpus.distinct) == (sum(counts.values()), 12)
        assert {bytes(r.word) for r in corpus.rare().collect()} | set(corpus.words) == set(counts) and corpus.rare().count() == 11 - want == corpus.rare_distinct
        assert corpus.rare_tokens == sum(n for w, n in counts.items() if w not in corpus.words)


def test_lm_probabilities_add_to_one():
    words = [b"\n", *(f"w{i}".encode() for i in range(300))]
    v = gru.Vocabulary(words, np.arange(301, 0, -1), 50, 128, 5)
    p = gru.start(v, 8)
    states = np.random.default_rng(0).standard_normal((3, 8)).astype(np.float32)
    for s in states:
        every = np.arange(v.n + 1)
        assert np.exp(gru.log_probabilities(p, v, np.repeat(s[None], v.n + 1, 0), every)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_unknown_words_are_the_last_class_and_not_remembered():
    v = gru.Vocabulary([b"\n", b"a", b"b"], np.array([3, 2, 1]), 5, 2, 3)
    assert v.encode([b"b", b"x", b"a", b"x"]).tolist() == [2, 3, 1, 3, 0] and v.encode([]).tolist() == [0]
    assert v.encode([b"x"]).dtype == np.int32 and b"x" not in v.rank


def test_lm_words_of_many_texts_are_those_of_each():
    every = "".join(chr(c) for c in range(256) if c not in range(0xD800, 0xE000))
    texts = [None, "", " ", "\x0b a\tB\r\n ", every, "\u0085x\u00a0y\u2003z \u1c80 \x1c \x1f\x00 ÀÉ é İ", "a b " * 50, "x"] * 3
    v = gru.Vocabulary([b"\n", b"a", b"b", "é".encode()], np.array([3, 2, 1, 1]), 5, 2, 3)
    for kind in (pa.string(), pa.large_string()):
        for most in (1, 60, 1 << 20):
            given = pa.array(["skipped", *texts], kind).slice(1)
            cut = list(lots(given, most))
            assert [x for lot in cut for x in lot.to_pylist()] == texts and (most > 1 << 19) == (len(cut) == 1)
            at = iter(texts)
            for lot in cut:
                found, times = space_words_together(lot)
                own = [space_words(next(at)) for _ in range(len(lot))]
                assert found.to_pylist() == [w for x in own for w in x] and times.tolist() == [len(x) for x in own]
                assert v.encode_together(found, times).tolist() == [i for x in own for i in v.encode(x).tolist()]
    assert list(lots(pa.array([], pa.string()), 5)) == []


def test_lm_step_leaves_its_gates_as_they_were():
    rng = np.random.default_rng(9)
    u, gates, h = (rng.standard_normal(s).astype(np.float32) for s in ((8, 24), (5, 24), (5, 8)))
    before = gates.copy()
    assert np.allclose(gru._advance(u, gates, h), gru._step({"u": u}, before, h)[0], atol=1e-5) and (gates == before).all()


def test_lm_state_is_carried_over_windows():
    words = [b"\n", *(f"w{i}".encode() for i in range(100))]
    v = gru.Vocabulary(words, np.arange(101, 0, -1), 5, 64, 3)
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(1, 102, n), 0) for n in (5, 200, 1, 33)] + [np.array([0])]
    p = gru.train(gru.start(v, 8), v, np.concatenate(docs * 5))
    plain = []
    for d in docs:
        h, before, total = np.zeros((1, 8), np.float32), 0, 0.0
        for t in d:
            h = gru._step(p, p["x"][[v.seen_as[before]]], h)[0]
            total += gru.log_probabilities(p, v, h, np.array([t]))[0]
            before = t
        plain.append(total)
    for width, window in ((512, 32), (2, 7), (1, 1)):
        assert gru.score(p, v, docs, width, window) == pytest.approx(plain, rel=1e-4)


def test_lm_training_learns_order():
    words = [b"\n", *(f"w{i}".encode() for i in range(20))]
    ids = np.array(([1, 2, 3, 4, 5] * 6 + [0]) * 60)
    v = gru.Vocabulary(words, np.bincount(ids, minlength=21) + 1, 1, 64, 3)
    p = gru.start(v, 8)
    doc = ids[:31]
    assert gru.score(gru.train(p, v, ids), v, [doc])[0] > gru.score(p, v, [doc])[0] + 10


def plain_losses(p, v, rows):
    """Mean loss of rows of ids that begin after an end, by the plain step in double precision."""
    p, total = {k: x.astype(float) for k, x in p.items()}, 0.0
    h, before = np.zeros((len(rows), len(p["u"]))), np.zeros(len(rows), int)
    for y in rows.T:
        h = gru._step(p, p["x"][v.seen_as[before]], h * (before != 0)[:, None])[0]
        for lane, t in enumerate(y):
            total -= gru._log_softmax((h[lane] @ p["wc"] + p["bc"])[None])[0, v.cls[t]]
            if t < v.head:
                total -= gru._log_softmax((h[lane] @ p["ww"][v.cls[t]] + p["bw"][v.cls[t]])[None])[0, t % gru.WIDTH]
        before = y
    return total / rows.size


@pytest.mark.parametrize("high", [0, 200])
def test_lm_first_step_goes_down_the_plain_gradient(monkeypatch, high):
    monkeypatch.setattr(gru, "BLOCK", 5)
    words = [b"\n", *(f"w{i}".encode() for i in range(100))]
    v = gru.Vocabulary(words, np.arange(101, 0, -1), 5, 80, 3)
    ids = np.random.default_rng(3).integers(0, 102, 16)
    ids[[4, 9]] = 0
    p = gru.start(v, 4)
    p["bc"] += np.float32(high)  # 200 is beyond float32's exp, and changes no probability
    squares = {k: np.ones_like(x) for k, x in p.items()}
    trained = gru.train(p, v, ids, window=16, rate=1e-3, squares=squares)  # with squares of 1 a step is all but the gradient
    losses = lambda q: plain_losses(q, v, ids[None])
    rng, moved, wanted = np.random.default_rng(5), [], []
    for k in gru.NAMES:
        for i in rng.permutation(np.flatnonzero((trained[k] != p[k]).reshape(-1)))[:6]:
            up, down = ({n: x.astype(float) for n, x in p.items()} for _ in range(2))
            up[k].reshape(-1)[i] += 1e-5
            down[k].reshape(-1)[i] -= 1e-5
            moved.append((p[k] - trained[k]).reshape(-1)[i] / 1e-3)
            wanted.append((losses(up) - losses(down)) / 2e-5)
    assert np.corrcoef(moved, wanted)[0, 1] > 0.99 and np.dot(moved, wanted) == pytest.approx(np.dot(wanted, wanted), rel=0.05)


def test_lm_logits_are_made_a_block_at_a_time():
    words = [b"\n", *(f"w{i}".encode() for i in range(300))]
    v = gru.Vocabulary(words, np.arange(301, 0, -1), 50, 128, 60)
    rng = np.random.default_rng(0)
    p, states, targets = gru.start(v, 8), rng.standard_normal((1 << 16, 8)).astype(np.float32), rng.integers(0, 302, 1 << 16)
    tracemalloc.start()
    gru.log_probabilities(p, v, states, targets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < states.shape[0] * v.classes * 4 / 2


def test_lm_trains_on_the_tail_that_does_not_fill_the_lanes():
    words = [b"\n", *(f"w{i}".encode() for i in range(20))]
    ids = np.array(([1, 2, 3, 4, 5] * 6 + [0]) * 133)[:4097]  # two lanes and one id over
    v = gru.Vocabulary(words, np.bincount(ids, minlength=21) + 1, 1, 64, 3)
    last = {k: gru.train(gru.start(v, 8), v, np.append(ids[:-1], k)) for k in (1, 7)}
    assert any((last[1][k] != last[7][k]).any() for k in gru.NAMES)
    assert all(np.isfinite(x[k]).all() for x in last.values() for k in gru.NAMES)


def test_lm_trains_on_every_learned_document(spark, sf_dir, documents, monkeypatch):
    seen, before = [], lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda texts, corpus: seen.append(collections.Counter(r.text for r in texts.collect())) or before(texts, corpus))
    QUERIES["op9_lm_score"](spark, sf_dir)
    assert seen == [collections.Counter(d.text for d in documents.values() if zlib.crc32(str(d.doc_id).encode()) % 7 != 2)]


def test_lm_odd_rows(spark, odd, none):
    corpus = lm_score.Corpus(common.save(lm_score.token_counts(odd.select("text")), "counts"))
    params = lm_score.train(odd.select("text"), corpus)
    rows = lm_score.score_documents(odd, corpus, params).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1} and all(np.isfinite(r.score) for r in rows)
    empty = lm_score.Corpus(common.save(lm_score.token_counts(none.select("text")), "counts"))
    assert empty.tokens == 0 and lm_score.score_documents(none, empty, lm_score.train(none.select("text"), empty)).count() == 0
    assert all(r.base_score == 0 for r in lm_score.score_documents(odd, empty, lm_score.train(none.select("text"), empty)).collect())


# 10 near duplicates


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        ids = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        bags = [tuple(np.array(x) for x in zip(*sorted((i, w) for i, w in zip(ids.tolist(), ws.tolist()) if w))) for ws in (a, b)]
        bags = [(x.astype(np.uint64), w) for x, w in bags]
        s = near_dup.signatures(bags, 400)
        errors.append((s[0] == s[1]).mean() - near_dup.weighted_jaccard(*bags))
    assert abs(np.mean(errors)) < 0.012 and np.abs(errors).max() < 0.11


def plain_classes(bags, exact):
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if exact[a] is not None and exact[a] == exact[b] or near_dup.weighted_jaccard(bags[a], bags[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_dup"](spark, sf_dir).collect()}
    hashes = WordHash()
    assert got == plain_classes({i: near_dup.bag(d.text, hashes) for i, d in documents.items()}, {i: d.text for i, d in documents.items()})


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A family whose members are near some, not all: groups with several classes, in blocks smaller than the group."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for j in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[j] = f"x{i}y{j}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "HOT", 7)
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()}
    copies = docs.unionByName(spark.range(1000, 1050).select(F.col("id").alias("doc_id"), F.lit(texts[5]).alias("text")))
    assert {r.class_id for r in near_dup.near_classes(copies).filter("doc_id >= 1000").collect()} == {got[5]}
    hashes = WordHash()
    want = plain_classes({i: near_dup.bag(t, hashes) for i, t in enumerate(texts)}, dict(enumerate(texts)))
    assert sum(got[i] != want[i] for i in got) <= 2  # banding finds a link at the border with probability 0.99995


def test_near_duplicates_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.class_id) for r in near_dup.near_classes(odd).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (None, None)}
    assert {(r.doc_id, r.n_copies) for r in near_dup.near_classes(odd).collect()} >= {(1, 2), (2, 1), (6, 2)}
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5]
    assert near_dup.near_classes(none).count() == 0 and near_dup.keep_one(none).count() == 0


def shifted(words: int, seed: int, change: int = 0) -> str:
    rng = np.random.default_rng(seed)
    out = [f"w{x}" for x in rng.integers(0, 5000, words)]
    for i in range(change):
        out[(i + 1) * words // (change + 1)] = f"y{seed}x{i}"
    return " ".join(out)


def test_near_duplicates_are_compared_once(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "A b, c"), (3, "a b c d e f g")], "id long, text string")
    found = near_dup.linked(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), texts)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1.0)]


def test_unlike_texts_under_one_id_are_neither_lost_nor_left_unlinked(spark):
    a, a2, b, b2, c = shifted(200, 1), shifted(200, 1, 2), shifted(200, 2), shifted(200, 2, 2), shifted(50, 3)
    rows = [(1, a, "x"), (1, b, "x"), (2, a2, "y"), (3, b2, "z"), (7, c, "p"), (7, c, "q"), (7, c, "q"), (None, c, "r"), (None, shifted(60, 4), "r"), (5, None, "n"), (5, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_copies, r.partner_id, r.similarity is not None and r.similarity >= 0.8) for r in near_dup.near_classes(docs).collect()), key=str)
    want = [(1, 1, 1, 2, True), (1, 1, 1, 3, True), (2, 1, 1, 1, True), (3, 1, 1, 1, True), (7, 7, 4, None, False), (7, 7, 4, None, False), (7, 7, 4, None, False), (None, 7, 4, None, False), (None, None, 1, None, False), (5, 5, 1, None, False), (5, 5, 1, None, False)]
    assert got == sorted(want, key=str)
    kept = [sorted((tuple(r) for r in near_dup.keep_one(docs.repartition(n)).collect()), key=str) for n in (1, 2, 5)]
    assert kept[0] == kept[1] == kept[2]
    # of (1, a), (2, a2) and of (1, b), (3, b2) one row each, one row of c, the text without an id, both null texts
    assert [r[:2] for r in kept[0]] == sorted([(1, a), (1, b), (7, c), (None, rows[8][1]), (5, None), (5, None)], key=str)


def test_near_duplicates_of_a_larger_table_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}
    hashes = WordHash()
    got = {r.doc_id: r.class_id for r in near_dup.op10_near_dup(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_classes({i: near_dup.bag(t, hashes) for i, t in docs.items()}, docs)


def shuffled_texts(df) -> int:
    """Rows with a text that df's plan shuffled."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and "text#" in node.output().toString():
            n += node.metrics().apply("shuffleRecordsWritten").value()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_documents_alone_in_their_class_are_not_shuffled(spark, monkeypatch):
    """Where the list of kept rows is too long to be broadcast."""
    monkeypatch.setattr(near_dup, "small", lambda df, rows=None: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = [(i, shifted(40, i)) for i in range(300)] + [(1000 + i, shifted(40, i)) for i in range(10)] + [(2000, None), (2000, None), (5, shifted(40, 5)), (None, shifted(40, 6))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        got = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == [*range(300), 2000, 2000]
    assert shuffled_texts(kept) < 100


def test_documents_are_kept_in_one_pass_where_the_others_are_broadcast(spark, tmp_path, monkeypatch):
    """Each file that is written starts processes on a machine without Hadoop's native library, so tables that nothing needs aren't written."""
    written = []
    for module in (common, near_dup):
        monkeypatch.setattr(module, "save", lambda df, name, save=common.save: (written.append(name), save(df, name))[1])
    rows = [(i, shifted(40, i % 60)) for i in range(70)] + [(100, shifted(200, 1)), (101, shifted(200, 1, 2)), (102, None), (102, None), (None, shifted(40, 3))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    kept = near_dup.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
    assert not {"met", "loud"} & set(written)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/docs") == 1 and "Union" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 100, 102, 102]


def test_lookup_of_few_and_of_many_rows_a_key(spark):
    left = spark.createDataFrame([(i, k) for i, k in enumerate("aaabbc")] + [(6, None), (7, "z")], "id long, k string")
    right = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v long")
    want = [(0, "a", 1), (1, "a", 1), (2, "a", 1), (3, "b", None), (4, "b", None), (5, "c", 3), (6, None, None), (7, "z", None)]
    for hot in (1, 2, 3):
        for saved in (False, True):
            found = common.lookup(left, right, "k", hot, saved)
            assert found.columns == ["k", "id", "v"] and sorted(tuple(r) for r in found.select("id", "k", "v").collect()) == want


def test_rows_that_a_join_may_meet(spark, monkeypatch):
    for bits in (common.FILTER_BITS, 1 << 16, 7):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        df = spark.range(5000).select(F.when(F.col("id") % 100 != 3, F.col("id").cast("string")).alias("k"), "id")
        got = {r.id: r["__open"] for r in common.may_meet(df, "k", df.filter("id % 10 = 0").select("k")).collect()}
        assert len(got) == 5000 and all(got[i] for i in range(0, 5000, 10)) and not any(got[i] for i in range(3, 5000, 100))
        assert bits == 7 or sum(got.values()) < 600
    assert not any(r["__open"] for r in common.may_meet(df, "k", df.limit(0).select("k")).collect())


# pipeline


def test_pipeline_stages(spark, sf_dir, documents):
    docs = common.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(kept["language_id"]) > 0.97 * len(documents)
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    clean = {i for i in kept["near_dup"] if not hits(documents[i].text, items)[1]}
    assert set(kept["decontaminate"]) == clean
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept["mix_sources"]) and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_pipeline_on_odd_rows_and_none(spark, sf_dir, odd, none):
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.save(stage(spark, docs, sf_dir), name)
            assert docs.columns == columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert sorted((r.doc_id for r in out), key=str) == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)


def test_digest_of_no_items(spark, sf_dir):
    rows = [r for r in QUERIES["op5_decontaminate"](spark, sf_dir).collect() if not r.n_items]
    assert rows and {r.items_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
