"""Rules in batches: the same hits as rule by rule, without a pattern in the plan; partitions that don't grow."""

import random
import re

from pyspark.sql import functions as F

from scholia.functions.rule_scan import compiled, scan
from scholia.functions.rule_table import FOLDED, RULES
from scholia.operators import rules
from scholia.sources import papers as sources


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain(texts):
    return [(i, k, *m.span()) for i, x in enumerate(texts) for k, (_, _, p) in enumerate(compiled()) for m in p.finditer(x)]


def hard_texts(n=400):
    rng, pieces = random.Random(4), []
    for r in RULES:
        pieces += [p for p in re.split(r"[()|\[\]{}?*+^$\\.]", r.pattern) if p.strip()]
    texts = ["".join(rng.choice([rng.choice(pieces), rng.choice(pieces).upper(), rng.choice("。\n ；$^_12%　٣\U0001f600"), rng.choice(FOLDED) + rng.choice("sni ")]) for _ in range(60)) for _ in range(n)]
    return [*texts, *[r.pattern.replace("s", FOLDED[2]).replace("i", FOLDED[k % 2]).replace("k", FOLDED[3]) for k, r in enumerate(RULES)], "", "p<.5", "$", "p"]


def found(texts):
    return [tuple(x) for x in zip(*(c.tolist() for c in scan(texts)), strict=True)]


def test_a_batch_has_the_hits_of_each_rule():
    for texts in (hard_texts(), ["p<.5", "0"], ["aim", "ed to"], ["", ""], []):
        assert found(texts) == plain(texts)


def test_full_items_come_from_a_scan(spark):
    """F14."""
    texts = hard_texts(20)
    rows = rules.full(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    assert RULES[0].pattern[:40] not in plan(rows)
    got = {r.doc_id: [x.hit for x in r["items"]] for r in rows.collect()}
    want = plain(texts)
    assert got == {i: [x[s:e] for j, _, s, e in want if j == i] for i, x in enumerate(texts)}


def test_partitions_of_papers_have_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "DEALT", 100)
    spark.range(5000).selectExpr("id AS p_partkey", "'n' AS p_name", "'T' AS p_type", "'B' AS p_brand", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    sizes = [r["count"] for r in sources.papers(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 120


def test_summary_counts_without_hits(spark):
    """hits of one document under one id count as one document, also over several rows."""
    texts = [*hard_texts(20), "In conclusion, fine."]
    rows = rules.summary(spark.createDataFrame([(i // 2, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    assert RULES[0].pattern[:40] not in plan(rows)
    want = plain(texts)
    assert {r.rule: (r.action, r.hits, r.docs, r.prior) for r in rows.collect()} == {RULES[k].name: (RULES[k].action, sum(x[1] == k for x in want), len({x[0] // 2 for x in want if x[1] == k}), RULES[k].prior) for k in {x[1] for x in want}}


def test_stats_count_without_hits(spark):
    """F24."""
    texts = [*hard_texts(20), None, "The framework model was quiet."]
    rows = rules.match_stats(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    assert RULES[0].pattern[:40] not in plan(rows)
    want = plain([x or "" for x in texts])
    count = lambda i, action: sum(j == i and RULES[k].action == action for j, k, _, _ in want)
    assert {r.doc_id: (r.keep_count, r.review_count) for r in rows.collect()} == {i: (count(i, "keep"), count(i, "review")) for i in range(len(texts))}


def test_markup_scans_rows_together(spark, monkeypatch):
    """a text that comes with its spans is not scanned again."""
    texts = [*hard_texts(5), None]
    want = [rules.marked_up(x, "review") for x in texts]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    assert [r.marked for r in rules.markup(rows, "review").orderBy("doc_id").collect()] == want
    own = rules.spans(texts)
    monkeypatch.setattr(rules, "scan", None)
    assert [rules.marked_up(x, "review", found=f) for x, f in zip(texts, own, strict=True)] == want
