"""Repair of answers: valid JSON cut anywhere parses again, strings keep what they say."""

import json
import random

from pyspark.sql import functions as F

from scholia.operators import text_ai


def some(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.choice([0, -7, 12.5, 1e20, -0.25, 3e-7])
    if kind < 4:
        return "".join(rng.choices(["a", "模", " ", '"', "\\", "\n", "{", "]", ",", ":", "5% up", "\U0001f600", "/", "\x01", "null", "\\u12"], k=rng.randint(0, 6)))
    if kind < 6:
        return {f"k{n}{rng.choice(['', '[', '%'])}": some(rng, depth + 1) for n in range(rng.randint(0, 3))}
    return [some(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def test_cut_anywhere(spark):
    """Every start of a valid object parses; the whole one is as it was; strings that were whole stay."""
    rng, texts = random.Random(3), []
    for n in range(60):
        value = {"first": some(rng), "then": {"list": [some(rng), {"x": some(rng)}], "s": some(rng)}, "last": some(rng)}
        text = json.dumps(value, ensure_ascii=n % 2 == 0, indent=[None, 1][n % 3 == 0])
        texts += [(text, k) for k in range(1, len(text) + 1)]
    rows = spark.createDataFrame([(t, k, t[:k]) for t, k in texts], "whole string, at int, cut string").repartition(4)
    for r in rows.select("whole", "at", "cut", text_ai.repaired(F.col("cut")).alias("made")).collect():
        try:
            got = json.loads(r.made)
        except ValueError:
            raise AssertionError(f"{r.cut!r} -> {r.made!r}") from None
        value = json.loads(r.whole)
        if r.at == len(r.whole):
            assert got == value
        done = list(got)[:-1]  # pairs before the last one were whole
        assert isinstance(got, dict) and all(got[k] == value[k] for k in done)


def test_what_models_write(spark):
    cases = {
        '{"a": [{"b": 1': {"a": [{"b": 1}]},
        '{"a": "rate: 5% up", "b": [1': {"a": "rate: 5% up", "b": [1]},
        '{"a": 63.8%, "b": "c,]", }': {"a": "63.8%", "b": "c,]"},
        '{"a": "\\alpha {", "b": -5%': {"a": "\\alpha {", "b": "-5%"},
        '{"a": [1, 2, ], "b": {"c": tr': {"a": [1, 2], "b": {"c": True}},
        '{"key" ': {"key": None},
        '{"a": 1, "key"': {"a": 1, "key": None},
        '{"a": ["x", "y"': {"a": ["x", "y"]},
        "{": {},
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: json.loads(r.made) for r in rows.select("t", text_ai.repaired(F.col("t")).alias("made")).collect()} == cases
    odd = spark.createDataFrame([(None,), ("",), ('{"a": "' + "\\n[" * 20000,)], "t string")
    got = [r[0] for r in odd.select(text_ai.repaired(F.col("t"))).collect()]
    assert got[:2] == [None, ""] and json.loads(got[2]) == {"a": "\n[" * 20000}
