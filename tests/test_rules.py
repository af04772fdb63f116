import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.functions.rule_table import RULES
from scholia.operators import rules

TEXTS = [
    "We propose a novel scheme to address the problem. It outperforms all baselines by 12%.\nIn recent years this was studied widely used\n",
    "本文提出了一种新方法，旨在解决延迟问题。实验结果表明准确率提高了 12.5%。近年来，随着技术的发展，越来越受到关注。",
    "基于 PyTorch 平台实现，在 GPU 上训练。所谓智能是指一种能力。为后续研究提供参考。大大提高了效率！",
    "Adam optimizer with learning rate 0.1, epochs 20; throughput of 300 Mbps; see Table 2 lists results\nEq. (3) and $x_1 = 2$ \U0001f600 Theorem 1 holds",
    "",
    "nothing at all",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")


def test_hits_equal_python(spark):
    got = sorted((r.doc_id, r.ord, r.n, r.hit) for r in rules.rule_hits(frame(spark)).collect())
    want = sorted((i, k, n, m) for i, t in enumerate(TEXTS) for k, r in enumerate(RULES) for n, m in enumerate(x.group() for x in re.finditer(r.pattern, t, re.I)))
    assert got == want
    assert {"implementation", "common_definition", "vague_prospect", "exaggeration"} <= {RULES[k].name for _, k, _, _ in want}


def test_offsets_and_snippets(spark):
    for r in rules.rule_matches(frame(spark)).collect():
        text = TEXTS[r.doc_id]
        assert text[r.start : r.end] == r.hit
        window = re.sub(r"([A-Za-z])-\s*\n\s*([a-z])", r"\1\2", text[r.snip_start : r.snip_end])
        assert r.snip_start <= r.start and r.snippet == re.sub(r"[ \t]{2,}", " ", re.sub(r"\s*\n\s*", " ", window)).strip()


def test_window_limits():
    text = "a" * 400 + " hit " + "b" * 100 + " " + "c" * 400
    left, right = rules.Sentences(text).window(401, 404)
    assert left == 401 - 320 and text[left:right].endswith("b" * 100)
    assert rules.Sentences("One. two hit three. Four").window(9, 12) == (4, 19)
    assert rules.Sentences("3.14 is pi\nand hit").window(15, 18) == (0, 18)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?。\n", max_size=40), st.integers(0, 40), st.integers(0, 10), st.integers(1, 30))
def test_window_equals_a_walk(text, start, size, reach):
    """Left: the last sentence end in reach, right: the first; without one the reach itself, on the right cut at a blank."""
    start, end = min(start, len(text)), min(start + size, len(text))
    ends = {0, *(k for k in range(1, len(text) + 1) if text[k - 1] in "。！？" or text[k - 1] in ".!?" and (k == len(text) or text[k].isspace()) or text[max(0, k - 2) : k] == "\n\n")}
    floor, ceiling = max(0, start - reach), min(len(text), end + reach)
    left = max([k for k in ends if floor < k <= start], default=floor)
    right = min([k for k in ends if end <= k <= ceiling], default=None)
    if right is None:
        blanks = [k for k in range(end + 1, ceiling) if text[k] == " "] if ceiling < len(text) else []
        right = max(blanks, default=ceiling)
    assert rules.Sentences(text).window(start, end, reach) == (left, right)


def test_stats_and_fallback(spark):
    rows = frame(spark, ["The framework model is here today! A method for analysis was tried! Short. performance performance is nice!", "We propose it."])
    stats = {r.doc_id: (r.keep_count, r.fallback_count) for r in rules.match_stats(rows).collect()}
    assert stats[0] == (0, 3) and stats[1][0] > 0 and stats[1][1] == 0 and stats[2] == (0, 0)
    found = rules.fallback_topk(rows).orderBy("rank").collect()
    assert [r.snippet for r in found] == ["The framework model is here today", "A method for analysis was tried", "performance performance is nice"]


def test_markup():
    text = "We propose a novel scheme. \nplain"
    marked = rules.marked_up(text, "extract")
    assert marked.startswith("**【核心】We propose") and marked.endswith("plain") and marked.count("【核心】") == 1
    assert rules.marked_up(text, "extract", compat=True).count("【核心】") == 2
    assert rules.marked_up("众所周知，这很好。", "review") == "⚠️【可能冗余】众所周知，这很好。⚠️"
    assert rules.marked_up(None, "extract") is None


def test_first_rule(spark):
    rows = spark.createDataFrame([("We propose to solve it",), ("plain",)], "s string")
    assert [r.r and r.r.rule for r in rows.select(rules.first_rule(F.col("s")).alias("r")).collect()] == ["problem_motivation", None]
