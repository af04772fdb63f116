import random

from pyspark.sql import functions as F

from scholia.operators import quota, rollup, text_ai
from scholia.operators import dataset
from scholia.sources import sinks
from scholia.streaming import usage


def test_window_edges(spark):
    rows = spark.createDataFrame([(1, "k", 0), (2, "k", 86400), (3, "k", 172801)], "event_id long, key string, ts long")
    assert [r.used for r in quota.rolling_count(rows, 86400).orderBy("event_id").collect()] == [1, 2, 1]
    rows = spark.createDataFrame([(1, "k", 0), (2, "k", 18000)], "event_id long, key string, ts long")
    assert [r.used for r in quota.rolling_count(rows, 18000, inclusive=False).orderBy("event_id").collect()] == [1, 1]


def test_reasons(spark):
    rows = [(k, k, "v1", "a") for k in range(7)] + [(100 + k, 100 + k, None, "b") for k in range(22)]
    got = {r.event_id: (r.reason, r.remaining) for r in quota.quota_check(spark.createDataFrame(rows, "event_id long, ts long, visitor string, ip string")).collect()}
    assert got[0] == ("ok", 5) and got[4] == ("ok", 1) and got[5] == ("visitor", 0)
    assert got[119][0] == "ok" and got[120] == ("ip", 0)


def test_admissions_batch(spark):
    rows = spark.createDataFrame([(k, "v", k) for k in range(8)] + [(9, "v", 86402)], "event_id long, key string, ts long")
    got = [r.event_id for r in usage.admissions(rows).where("admitted").orderBy("event_id").collect()]
    assert got == [0, 1, 2, 3, 4, 9]


def test_streams_agree_with_batch(spark, small, tmp_path):
    source = spark.read.parquet(f"{small}/events.parquet")
    (source.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in")))
    stream = usage.windowed_counts(usage.read_events(spark, str(tmp_path / "in")), "1 day", "1 day")
    started = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    started.processAllAvailable()
    started.stop()
    got = {(r.start, r.user_id): r.uses for r in spark.table("windows").collect()}
    batch = source.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "user_id").count()
    assert got == {(r.window.start, r.user_id): r["count"] for r in batch.collect()} and got


def test_answers(spark):
    rows = spark.createDataFrame([(0, '```json\n{"结论": "a", "主要结论": "b", "x": [1]}\n```'), (1, "say {\"key\": \"v\"} ok"), (2, "plain"), (3, "")], "k int, raw string")
    got = {r.k: [(x.key, x.value) for x in r.a] for r in rows.select("k", text_ai.parse_answer(F.col("raw")).alias("a")).collect()}
    assert got == {0: [("conclusion", "a"), ("x", "[1]")], 1: [("key", "v")], 2: [("raw", "plain")], 3: [("raw", "")]}


def test_summary_and_thoughts(spark):
    text = "甲乙。" + "模型模型模型很好。" + "其他。" + "模型结果。" + "尾巴。"
    rows = spark.createDataFrame([(0, text), (1, "短。"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r.summary for r in text_ai.summarize(rows).collect()}
    assert "模型模型模型很好。" in got[0] and got[1] == "短。" and 2 not in got
    rows = spark.createDataFrame([("<think>a</think> b",), ("x</think>y <think>z</think>",), ("c",)], "t string")
    assert [r[0] for r in rows.select(text_ai.strip_think(F.col("t"))).collect()] == ["b", "", "c"]


def test_dataset(spark):
    rows = spark.createDataFrame([("t", f"s{k}", "是" if k % 3 else "否", f"p{k % 7}") for k in range(100)] + [("t", "s0", "否", "p9")], "instruction string, input string, output string, _paper string")
    once = dataset.dedup_rows(rows)
    assert once.count() == 100
    capped = dataset.cap_per_class(once, 20)
    assert sorted(r["count"] for r in capped.groupBy("output").count().collect()) == [20, 20]
    split = dataset.split_by_paper(once, 0.2)
    sides = split.groupBy("_paper").agg(F.count_distinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in sides) and {r.split for r in split.collect()} == {"train", "val"}


def test_gold(spark):
    gold = spark.createDataFrame([("p", ["We propose x."], ["We propose x.", "The dataset is large.", "Nothing."])], "paper string, core array<string>, candidates array<string>")
    got = {(r.instruction, r.output) for r in dataset.gold_labels(gold).collect()}
    assert got == {("is_core", "是"), ("is_core", "否"), ("pick_core", "We propose x.")}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert sorted(map(tuple, rollup.insert_or_ignore(old, new, "k", ["v"]).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, rollup.insert_or_replace(old, new.where("k = 1"), "k").collect())) == [(1, "b")]


def test_values_and_repairs(spark):
    rows = spark.createDataFrame([('["a", 1, null]',), ('{"k": "v", "n": 2}',), ("plain [x]",), (None,), ("[broken",)], "v string")
    assert [r[0] for r in rows.select(text_ai.flat_value(F.col("v"))).collect()] == ["a；1；None", "k：v；n：2", "plain [x]", None, "[broken"]
    broken = ['{"结论": "a", "x": 63.8%, }', '{"a": ["b", "c"', 'so {"t": "\\alpha \\n"}', '{"a": {"b": 1}', "no object"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(broken)], "k int, raw string")
    got = {r.k: [(x.key, x.value) for x in r.a] for r in rows.select("k", text_ai.parse_answer(F.col("raw")).alias("a")).collect()}
    assert got == {0: [("conclusion", "a"), ("x", "63.8%")], 1: [("a", '["b","c"]')], 2: [("t", "\\alpha \n")], 3: [("a", '{"b":1}')], 4: [("raw", "no object")]}


def test_purge_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    left, gone = sinks.purge(rows, ["a", "z"])
    assert gone == 1 and [r.id for r in left.collect()] == ["b"]
    left, gone = sinks.purge(rows)
    assert gone == 2 and left.count() == 0


def test_gold_folder(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"gold_core_sentences": ["We  propose a method that is new."], "candidates": ["We propose a method that is new.", "short", "The dataset holds many images of cats."]}', "utf-8")
    (tmp_path / "p2.json").write_text("{broken", "utf-8")
    got = dataset.read_gold(spark, str(tmp_path)).collect()
    assert [(r.paper, r.core, len(r.candidates)) for r in got] == [("p1.json", ["We propose a method that is new."], 2)]
