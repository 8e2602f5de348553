"""Functions called by name in SQL text, and the record archive."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row

from quarterlight.functions import registered
from quarterlight.functions.fixed_values import REWARD_WEIGHTS
from quarterlight.queries.corpus import rewarded
from quarterlight.sources import archive


@pytest.fixture(scope="module")
def named(spark):
    registered.register(spark)
    return spark


def test_parse_page_has_the_parsers_columns(named):
    page = "'<title>A  b</title><p>One <b>two</b></p><time datetime=\"2024-03-05\">x</time>'"
    assert [tuple(r) for r in named.sql(f"SELECT * FROM parse_page({page}, 'document')").collect()] == [("A b", "One two", "2024-03-05")]
    assert named.sql(f"SELECT * FROM parse_page({page}, 'plain')").columns == ["text"]
    assert named.sql("SELECT text FROM parse_page(CAST(NULL AS STRING), 'plain')").first().text == ""
    with pytest.raises(AnalysisException, match="must be one of"):
        named.sql("SELECT * FROM parse_page('x', 'unknown')")


def test_json_walk_by_kind(named):
    record = """'{"a": [1, true, {"b": "x"}], "c": null, "d": 2.5, "e": "y"}'"""
    walk = lambda kind: [tuple(r) for r in named.sql(f"SELECT * FROM json_walk({record}, '{kind}')").collect()]
    assert walk("string") == [("$.a[2].b", "x"), ("$.e", "y")] and walk("number") == [("$.a[0]", 1.0), ("$.d", 2.5)] and walk("boolean") == [("$.a[1]", True)]
    assert named.sql("SELECT * FROM json_walk('not json', 'string')").collect() == [] and named.sql("SELECT * FROM json_walk(NULL, 'string')").collect() == []


def test_rewards_by_name_score_as_the_components(named, sf_dir):
    rows = rewarded(named, sf_dir).filter("complete IS NOT NULL")
    got = named.sql(
        """SELECT fed_probability_calibrated AS a, reward_probability_calibrated(h, o, c, actual) AS a2, no_future_leakage AS b, reward_no_future_leakage(CAST(future_mentions AS INT)) AS b2,
        lower_regret AS c, reward_lower_regret(regret) AS c2, fewer_convergence_rounds AS d, reward_fewer_rounds(rounds) AS d2, stable_after_10_rounds AS e, reward_stability(converged, stable_rounds) AS e2 FROM {rows}""",
        rows=rows,
    ).collect()
    assert got and all(r[x] == pytest.approx(r[f"{x}2"], abs=1e-6) for r in got for x in "abcde")
    one = lambda text: named.sql(f"SELECT {text} AS v").first().v
    assert one("reward_lower_regret(0.1D)") == 0.6 and one("reward_fewer_rounds(11)") == 0.5 and one("reward_stability(false, 4)") == -0.1 and one("reward_stability(true, NULL)") == 1.0
    names = list(REWARD_WEIGHTS)[:2]
    weights = [REWARD_WEIGHTS[n] for n in names]
    want = (0.5 * weights[0] - 0.25 * weights[1]) / sum(map(abs, weights))
    assert one(f"reward_weighted(map('{names[0]}', 0.5D, '{names[1]}', -0.25D))") == pytest.approx(want, abs=1e-9)


def test_records_are_one_file_each_and_replaced(spark, tmp_path):
    archive.register(spark)
    path = f"{tmp_path}/records"
    write = lambda rows: spark.createDataFrame(rows, "event_id string, note string").repartition(3).write.format("record_archive").option("key", "event_id").mode("append").save(path)
    write([("a/1", "x"), ("b", "y"), ("c", None)])
    write([("b", "new"), ("d", "z")])
    assert sorted(f for f in os.listdir(path) if not f.startswith("_")) == ["a%2F1.json", "b.json", "c.json", "d.json"] and os.listdir(f"{path}/_pending") == []
    assert {(r.event_id, r.note) for r in spark.read.schema("event_id string, note string").json(path).collect()} == {("a/1", "x"), ("b", "new"), ("c", None), ("d", "z")}
    with pytest.raises(Exception, match="has no event_id"):
        write([("e", "1"), (None, "2")])
    assert spark.read.schema("event_id string").json(path).count() == 4 and not os.path.exists(f"{path}/e.json")


def test_a_streams_replay_leaves_no_second_record(spark, tmp_path):
    archive.register(spark)
    source, path = f"{tmp_path}/in", f"{tmp_path}/records"
    schema = "event_id string, note string"
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.json(source)
    for check in ("one", "two"):  # a lost checkpoint replays all
        writer = spark.readStream.schema(schema).json(source).writeStream.format("record_archive").option("path", path).option("checkpointLocation", f"{tmp_path}/{check}")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(f for f in os.listdir(path) if not f.startswith("_")) == ["a.json", "b.json"]


def test_records_in_folders_are_read_by_tasks(spark, tmp_path):
    """Records lie in folders by a hash of their names; tasks list them, so the driver plans a partition for some folders, not one for some files."""
    archive.register(spark)
    for buckets in (0, 20):
        path = f"{tmp_path}/records{buckets}"
        write = lambda rows: spark.createDataFrame(rows, "event_id string, n int").coalesce(1).write.format("record_archive").option("buckets", buckets).mode("append").save(path)  # noqa: E731, B023
        write([(f"a/{i}", i) for i in range(50)])
        # of equal keys the last holds
        write([("a/7", 70), *((f"b{i}", i) for i in range(8)), ("a/7", 77)])
        write([])
        found = [os.path.relpath(os.path.join(at, f), path) for at, _, names in os.walk(path) for f in names]
        assert len(found) == 58 and os.listdir(f"{path}/_pending") == [] and all(f.count("/") == (buckets > 0) for f in found)
        read = spark.read.format("record_archive").option("buckets", buckets).load(path)
        assert read.rdd.getNumPartitions() == (3 if buckets else 1)
        rows = [json.loads(r.value) for r in read.collect()]
        assert {r["event_id"]: r["n"] for r in rows} == {**{f"a/{i}": i for i in range(50)}, **{f"b{i}": i for i in range(8)}, "a/7": 77} and len(rows) == 58


def test_a_commit_holds_the_names_of_a_lot(tmp_path, monkeypatch):
    held = []
    pool = archive.ThreadPoolExecutor
    monkeypatch.setattr(archive, "LOT", 10, raising=False)
    monkeypatch.setattr(archive, "ThreadPoolExecutor", lambda n: type("Pool", (pool,), {"map": lambda self, f, names: (held.append(len(names)), pool.map(self, f, names))[1]})(n))
    writer = archive._StreamWriter({"path": f"{tmp_path}/records"})
    writer.commit([writer.write(Row(event_id=str(i % 95), i=i) for i in range(97)), None], 0)
    assert sorted(os.listdir(f"{tmp_path}/records")) == sorted([*(f"{i}.json" for i in range(95)), "_pending"])
    assert held == [10] * 9 + [7]
    assert [json.loads(open(f"{tmp_path}/records/{i}.json").read())["i"] for i in (0, 1, 2)] == [95, 96, 2]
