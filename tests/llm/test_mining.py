"""Phrases, spelling variants and vector near duplicates against brute force."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.llm import phrases, spelling, vector_dups
from tests.compare import database, spark_rows, sql_rows

# phrases


def brute_phrases(docs, least, cover, top):
    """Plain counts of every phrase; docs: (lang, text)."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        kept = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * c >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in kept.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


PHRASE_DOCS = [
    ("en", "New York City is big. New York, city! New york\tCity is  big"),
    ("en", "a a a a a a a"),
    ("en", "a a a a a a a"),
    ("de", "Ärger über Ärger über ärger;  x y z - y z"),
    (None, "x y z. X Y Z\nx y z x y z"),
    ("und", "x y"),
    ("fr", None),
    ("es", ""),
    ("es", ".,;:!? \t\n\r"),
]


def phrase_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("least,top", [(2, 2000), (1, 3)])
def test_phrases_equal_brute_force(spark, least, top):
    docs = spark.createDataFrame(PHRASE_DOCS, "lang string, text string").withColumns({"phrase": F.lit("mine"), "f": F.lit(1), "size": F.lit(2)})
    assert phrase_rows(phrases.collocations(docs, least=least, top=top)) == brute_phrases(PHRASE_DOCS, least, 80, top)


def test_long_texts_are_cut_without_losing_phrases():
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["a", "bb", "ccc", "d.", "Ee"], 400))
    for size in (7, 40, 5000):
        counted = collections.Counter()
        for words, old in phrases.slices(text.encode(), size):
            counted.update(tuple(words[i - 3 : i + 1]) for i in range(max(3, old), len(words)) if b"\n" not in words[i - 3 : i + 1])
        whole = [w for w in text.encode().translate(phrases._FOLD).replace(b"\n", b" \n ").split(b" ") if w]
        assert counted == collections.Counter(tuple(whole[i : i + 4]) for i in range(len(whole) - 3) if b"\n" not in whole[i : i + 4])
    assert list(phrases.slices(b"x" * 50, 7))[0][0] == [b"x" * 50]


def test_small_lots_and_a_full_bitmap_change_nothing(spark):
    docs = [("en" if i % 3 else None, f"the cat number {i % 4} sat on the mat, the cat sat") for i in range(60)]
    want = brute_phrases(docs, 5, 80, 2000)
    for bits, lot in ((phrases.BITS, 200), (64, 200), (1 << 12, 10_000)):
        assert phrase_rows(phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), least=5, bits=bits, lot_bytes=lot)) == want


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_op11_equals_sql(spark, sf_dir):
    assert spark_rows(phrases.op11_phrases(spark, sf_dir)) == sql_rows(database(sf_dir), phrases.OP11_SQL)


# spelling


def brute_spelling(docs, occurrences=3, least=5):
    count = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= occurrences}
    letters = {c for w in words for c in w}

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return (out & words.keys()) - {w}

    form, many = {}, {}
    for w, n in words.items():
        met = near(w)
        many[w] = len(met)
        best = min(met, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, many[w], words[form[w]] if form[w] else None))
    return sorted(rows)


def spelling_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_op12_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_spelling(docs)
    assert len(want) > 1000 and any(r[1] for r in want)
    assert spelling_rows(spelling.op12_spelling(spark, sf_dir)) == want


def test_variants_on_edges(spark):
    docs = [(1, "colour Colour colour colour color color color colur colur colur"), (1, "colour colour colour colour"), (2, None), (3, ""), (None, "hello hello hello hallo"), (4, "Hallo hallo"), (5, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa")]
    docs += [(6, "Ärger×÷ " * 4 + "Ärgerx×÷ " * 9 + "Ābcdef " * 3), (7, "x" * 3000 + " "), (8, ("y" * 70_000 + " ") * 3)]
    docs += [(9, "abcde abcde abcde abdce abdce abdce fghij fghij fghij")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("mine"), "n": F.lit(0)})
    want = [r for r in brute_spelling([d for d in docs if d[0] not in (7, 8)])]
    got = spelling_rows(spelling.variants(df))
    assert [r for r in got if len(r[0]) < 100] == want
    assert [r[3:] for r in got if len(r[0]) > 100] == [(3, 0, None)]
    assert spelling.variants(df.filter("doc_id = 2")).collect() == []
    assert spelling.variants(df.limit(0)).collect() == []


def test_split_branches_and_large_leaves_find_the_same(spark):
    rng = np.random.default_rng(5)
    made = {"".join(rng.permutation(list("abcdefg"))) for _ in range(700)} | {"".join(rng.choice(list("abix"), 6)) for _ in range(500)}
    words = {w: int(n) for w, n in zip(sorted(made), rng.integers(3, 40, len(made)))}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    want = {r[0]: r[3:5] for r in brute_spelling(docs)}
    words_df = spark.createDataFrame([(w, n) for w, (n, _) in want.items()], "word string, n long")
    for branch, leaf, few in ((20_000, 40_000, 16), (13, 40_000, 16), (13, 50, 2), (20_000, 1, 1)):
        got = {r.word: r.n_near for r in spelling.near_words(words_df, branch, leaf, few).collect()}
        assert {w: got.get(w, 0) for w in want} == {w: x for w, (_, x) in want.items()}


# vectors


def brute_vectors(rows, similarity=0.93):
    """rows: (vec_id, embedding, label)."""

    def fine(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1:]
            if a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
                x, y = (np.array(z) / np.abs(z).max() for z in (v, w))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity or tuple(v) == tuple(w):
                    n[i] += 1
                    n[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[root(i)] = min(least.get(root(i), vec_id), vec_id)
    return sorted(((r[0], n[i], least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows)), key=str)


def vector_rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def family(rng, centre, n, spread):
    return [(centre + spread * rng.standard_normal(len(centre))).tolist() for _ in range(n)]


def many_vectors():
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(300)]
    for k in range(12):  # families around the threshold
        rows += [(400 + 40 * k + i, v, k % 4) for i, v in enumerate(family(rng, rng.standard_normal(16), 30, 0.05 + 0.03 * k))]
    rows += [(2000 + i, rows[5][1], 2) for i in range(150)]
    rows += [(3000 + i, [2 * c for c in rows[5][1]], 2) for i in range(3)]
    rows += [(7, rows[9][1], 0), (7, rows[9][1], 0), (None, rows[9][1], 0), (None, [0.5] * 16, 1), (4000, [1.0] * 5, 0), (4001, [1.0] * 5, 0), (4002, [1.0], 0), (4003, [3.0], 0), (4004, [-3.0], 0)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (5003, [None] + [1.0] * 15, 1), (5004, [float("nan")] * 16, 1), (5005, [float("inf")] * 16, 1), (5006, rows[0][1], None), (5007, rows[0][1], None)]
    rows += [(6000, [1e-200] * 16, 1), (6001, [1e200] * 16, 1)]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("recall,k,block", [(1.0, 6, 1024), (0.9999, 6, 1024), (1.0, 3, 40)])
def test_vectors_equal_brute_force(spark, recall, k, block):
    rows = many_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit(1), "class": F.lit("x"), "key": F.lit(None)})
    assert vector_rows(vector_dups.vector_classes(df, recall=recall, codewords_by_half=k, block=block, visitors_at_once=2 * block)) == brute_vectors(rows)


def test_few_vectors(spark):
    assert vector_dups.vector_classes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_rows(vector_dups.vector_classes(spark.createDataFrame([(3, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (1, None, None)], VECTORS))) == [(1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_visits_lose_no_cell_and_rise(spark):
    rng = np.random.default_rng(2)
    x = vector_dups.unit(rng.standard_normal((3000, 32)))
    for recall in (1.0, 0.999):
        index = vector_dups.MultiIndex(x, 16, recall=recall)
        one, two = index.taken(x[:500])
        aside = rng.standard_normal((500, 32))
        aside -= (aside * x[:500]).sum(1)[:, None] * x[:500]
        partner = 0.93 * x[:500] + (1 - 0.93**2) ** 0.5 * vector_dups.unit(aside)
        row, cell = index.visits(x[:500])
        own = index.cells(partner)
        met = {(r, c) for r, c in zip(row.tolist(), cell.tolist())}
        share = np.mean([(i, c) in met for i, c in enumerate(own.tolist())])
        assert share == 1 if recall == 1 else share >= 0.99
        taken = (one[:, :, None] + two[:, None]).reshape(500, -1)
        assert (np.diff(taken[row, cell])[row[1:] == row[:-1]] >= 0).all()
    assert len(row) < 0.6 * 500 * 256  # with a target the visits end far before all cells are seen


def test_op13_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert vector_rows(vector_dups.op13_vector_dups(spark, sf_dir)) == brute_vectors(rows)
