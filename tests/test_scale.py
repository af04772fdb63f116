"""What a larger table asks of plans: texts composed once, rows dealt evenly, no broadcast of what grows, linear windows."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scholia.functions.rule_table import FOLDED, RULES, searched
from scholia.operators import dataset, quota, rollup, rules, salience, score
from scholia.sources import papers as sources
from scholia.streaming import state


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def composed(spark):
    """Papers whose text is made by an expression, as those of the part table are."""
    return spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("The framework near river "), F.sha1(F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, ". In conclusion, fine.").otherwise(". Nobody came.")).alias("text"))


def test_texts_are_composed_once(spark):
    for rows, n in ((rules.fallback_topk(composed(spark)), 20), (rules.matches_union(composed(spark)).where("is_fallback"), 20)):
        assert plan(rows).count("sha1(") == 1
        assert rows.count() == n


def test_looks_ahead_find_the_same(spark):
    rng, pieces = random.Random(3), []
    for r in RULES:
        pieces += [p for p in re.split(r"[()|\[\]{}?*+^$\\.]", r.pattern) if p.strip()]
    texts = ["".join(rng.choice([rng.choice(pieces), rng.choice(pieces).upper(), rng.choice("。\n ；$^_12%"), rng.choice(FOLDED) + rng.choice("sni ")]) for _ in range(60)) for _ in range(200)]
    texts += [r.pattern.replace("s", FOLDED[2]).replace("i", FOLDED[k % 2]).replace("k", FOLDED[3]) for k, r in enumerate(RULES)]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in RULES:
        old, new = re.compile(r.pattern, re.I), re.compile(searched(r), re.I)
        assert [[m.span() for m in old.finditer(x)] for x in texts] == [[m.span() for m in new.finditer(x)] for x in texts]
    both = [F.array(*[F.regexp_extract_all("text", F.lit(rules.FLAGS + p(r)), F.lit(0)) for r in RULES]) for p in (lambda r: r.pattern, searched)]
    assert docs.where(both[0] != both[1]).count() == 0


def test_papers_are_dealt_evenly(spark, tmp_path):
    """One row group in a file of several splits: all rows come with one of them."""
    parts = spark.range(20000).selectExpr("id AS p_partkey", "sha1(cast(id AS string)) AS p_name", "'T' AS p_type", "'B' AS p_brand", "1 AS p_size").coalesce(1)
    parts.write.option("compression", "uncompressed").parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        sizes = sources.papers(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sizes.sum() == 20000 and sizes.max() < 4 * 20000 / 16


def uses(rng, n):
    return [(k, rng.choice("abc"), rng.choice((rng.randrange(-300, 300), 100 * rng.randrange(-3, 4)))) for k in range(n)]


def test_rolling_counts_of_every_kind(spark):
    rows = uses(random.Random(5), 400)
    table = spark.createDataFrame(rows, "event_id long, key string, ts long")
    for inclusive in (True, False):
        for own in (True, False):
            low, high = 100 if inclusive else 99, 0 if own else 1
            want = {e: sum(x == k and t - low <= u <= t - high for _, x, u in rows) for e, k, t in rows}
            assert {r.event_id: r.used for r in quota.rolling_count(table, 100, inclusive, own).collect()} == want


def test_rolling_counts_have_no_sliding_frame(spark):
    """A frame with a lower bound costs its rows anew for each row."""
    table = spark.createDataFrame(uses(random.Random(6), 5), "event_id long, key string, ts long")
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", plan(quota.rolling_count(table, 100)))
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_nothing_that_grows_is_broadcast(spark):
    """Composed texts count as short columns, so Spark's own size check would broadcast their terms."""
    docs = composed(spark)
    hits = salience.salience(docs)
    scored = docs.select("doc_id", F.lit(1).alias("text_length"), *[F.lit(1).alias(c) for c in ("total", "structure", "innovation", "data_support", "method")])
    scored = scored.selectExpr("*", *[f"1 AS {c}" for c in ("missing", "innovation_hits", "n_conc", "n_expr", "n_cross", "covered", "categories", "method_hits")], "false AS no_keywords")
    for rows in (hits, rollup.overview(scored, hits), rollup.report_text(scored, hits)):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_decisions_skip_refused_events():
    rng = random.Random(8)
    for cap in (0, 1, 3):
        ts = sorted(rng.randrange(0, 60) for _ in range(80))
        uses, want = [-5, -2][:cap], []
        for t in ts:
            uses = [u for u in uses if u >= t - 10]
            want.append(len(uses) < cap)
            uses += [t] if want[-1] else []
        got, left = state.decided(np.array(ts), [-5, -2][:cap], cap, 10)
        assert got.tolist() == want and left == uses


def test_a_hot_key_waits_in_few_elements(spark):
    """Its events are packed: an element of the state for each Arrow batch, not for each event."""

    class States(dict):
        def getListState(self, name, schema):
            self[name] = self
            self.values = getattr(self, "values_", [])
            self.values_ = self.values
            return self

        def appendValue(self, value):
            self.values_.append(value)

        def registerTimer(self, at):
            self.timers = [*getattr(self, "timers", []), at]

    one, handle = state.Admission(5, 10), States()
    one.init(handle)
    batches = [pd.DataFrame({"ts": range(k, 1000), "event_id": range(k, 1000)}) for k in (7, 3)]
    list(one.handleInputRows(("k",), iter(batches), None))
    assert len(handle.values_) == 2 and handle.timers == [3000]


def test_papers_are_graded_once(spark):
    scored = score.score_all(composed(spark), "teacher", "cs")
    assert plan(score.suggestions(scored)).count("sha1(") == 1


def test_weak_labels_run_the_rules_once(spark):
    assert plan(dataset.weak_labels(composed(spark))).count(RULES[0].pattern[:40]) == 1
