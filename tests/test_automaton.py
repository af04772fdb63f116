"""Many keywords at once against ``contains``, whatever their number, and the time that takes."""

import random
import time

from pyspark.sql import functions as F

from scholia.functions import automaton, fixed, lexicon
from scholia.operators import score
from scholia.sources import papers as sources


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdeﬁéß模型训练", k=rng.randint(1, 9))) for _ in range(n)]


def test_equals_contains(spark):
    """Words inside words, at both ends, overlapping, in capitals, repeated, empty; null and empty texts."""
    words = ["he", "she", "hers", "his", "SHE", "", "模型", "型", "a", "xyz"]
    texts = ["ushers", "HIS model 模型", "", None, "aaa", "x" * 100 + "yz", "\U0001f600he"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    want = {k: [w for w in lexicon.distinct([w for w in words if w]) if w in (t or "").lower()] for k, t in enumerate(texts)}
    assert {r.doc_id: r.f0 for r in automaton.with_contained(df, ["text"], "f", [words]).collect()} == want
    assert all(r.f0 == [] for r in automaton.with_contained(df, ["text"], "f", [[]]).collect())


def test_blocks_of_a_large_lexicon(spark, monkeypatch):
    """Cut into blocks, a lexicon finds the same words."""
    words, rng = vocabulary(500), random.Random(2)
    keywords = spark.createDataFrame([(f"s{k % 7}", f"c{k % 3}", w) for k, w in enumerate(words)] + [("s0", None, "a"), (None, "c0", "a"), ("s0", "c0", None)], "subject string, category string, word string")
    docs = spark.createDataFrame([(k, "".join(rng.choices("abcdeﬁéß模型训练 ", k=60))) for k in range(40)] + [(99, None)], "doc_id int, text string")
    whole = sorted(map(tuple, automaton.counted(docs, keywords).collect()))
    monkeypatch.setattr(automaton, "LIMIT", 300)
    assert sorted(map(tuple, automaton.counted(docs, keywords).collect())) == whole
    text, want = {r.doc_id: (r.text or "").lower() for r in docs.collect()}, []
    for d, t in text.items():
        for s in range(7):
            own = {(f"c{k % 3}", w.lower()) for k, w in enumerate(words) if k % 7 == s}
            hits = {(c, w) for c, w in own if w in t}
            if hits:
                want.append((d, f"s{s}", len({c for c, _ in hits}), len({c for c, _ in own}), len({w for _, w in hits})))
    assert whole == sorted(want)
    assert automaton.counted(docs, keywords.limit(0)).count() == 0 and automaton.counted(docs.limit(0), keywords).count() == 0


def test_time_does_not_grow_with_the_lexicon():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij", k=400_000))
    took = []
    for n in (1_000, 20_000):
        words = tuple({"".join(rng.choices("abcdefghij", k=rng.randint(9, 14))) for _ in range(n)})
        automaton.contained("a", words)
        began = time.perf_counter()
        automaton.contained(text, words)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.05


def test_grades_are_the_same_either_way(spark, small, monkeypatch):
    """A lexicon of the survey's size grades as the expressions do; a longer one changes grades."""
    docs = sources.papers(spark, small).where(F.col("doc_id") % 4 == 3)
    plain = sorted(map(tuple, score.score_all(docs, "teacher", "cs").collect()))
    monkeypatch.setattr(score, "MANY", 0)
    assert sorted(map(tuple, score.score_all(docs, "teacher", "cs").collect())) == plain
    full = {"innovation": {m: [*lexicon.INNOVATION[m], *vocabulary(150, 4)] for m in fixed.PROFILES}, "method": {m: [*lexicon.METHOD[m], *vocabulary(250, 5)] for m in fixed.PROFILES}, "rubrics": {s: {c: [*w, *vocabulary(30, 6)] for c, w in r.items()} for s, r in lexicon.RUBRICS.items()}}
    rows = sorted(map(tuple, score.score_all(docs, "teacher", "cs", lexicon=full).collect()))
    monkeypatch.setattr(score, "MANY", 10**6)
    assert sorted(map(tuple, score.score_all(docs, "teacher", "cs", lexicon=full).collect())) == rows != plain
