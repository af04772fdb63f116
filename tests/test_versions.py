"""Commits of a versioned table: upserts, two writers, a writer that dies, older versions."""

import math

import pytest

from scholia.operators import salience
from scholia.sources.versions import Conflict, Versions

DDL = "k long, v string"


@pytest.fixture
def made(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([], DDL).schema, "k", 4)


@pytest.fixture(scope="module")
def rows(spark):
    return lambda *pairs: spark.createDataFrame(pairs, DDL)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_are_commits(made, rows):
    assert found(made.read()) == [] and made.versions() == [0]
    assert made.insert_or_ignore(rows((1, "a"), (1, "b"), (2, "c")), ["v"]) == 1
    assert made.insert_or_ignore(rows((2, "x"), (3, "d")), ["v"]) == 2
    assert made.insert_or_replace(rows((1, "z"), (9, "y"))) == 3
    assert made.delete(rows((2, ""), (77, ""))) == 4
    assert made.append(rows((3, "again"), (None, "null"))) == 5
    assert found(made.read()) == found(rows((1, "z"), (9, "y"), (3, "d"), (3, "again"), (None, "null")))
    assert found(made.read(1)) == [(1, "a"), (2, "c")] and found(made.read(3)) == [(1, "z"), (2, "c"), (3, "d"), (9, "y")]
    assert made.replace(made.read().where("k = 3")) == 6
    assert found(made.read()) == [(3, "again"), (3, "d")] and made.versions() == list(range(7))
    with pytest.raises(ValueError):
        made.read(99)


def test_untouched_buckets_stay(made, rows):
    """A change writes the buckets of its keys and no others."""
    made.insert_or_replace(rows(*[(k, "old") for k in range(40)]))
    before = made._manifest(None)[1]["data"]
    made.insert_or_replace(rows((5, "new")))
    after = made._manifest(None)[1]["data"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert found(made.read()) == found(rows(*[(k, "new" if k == 5 else "old") for k in range(40)]))


def test_two_writers(spark, made, rows):
    """The second of two commits from one state is done again on the first one's; none is lost."""
    made.insert_or_ignore(rows((1, "a")), ["v"])
    other, touched, waits = Versions(spark, made.path), made._touched, [True]

    def late(manifest, changed):
        if waits.pop() if waits else False:
            other.insert_or_ignore(rows((2, "theirs"), (3, "theirs")), ["v"])
        return touched(manifest, changed)

    made._touched = late
    assert made.insert_or_ignore(rows((2, "ours"), (4, "ours")), ["v"]) == 3
    assert found(made.read()) == [(1, "a"), (2, "theirs"), (3, "theirs"), (4, "ours")]
    with pytest.raises(Conflict):
        other._publish(2, {})
    with pytest.raises(Conflict):
        other.create(rows((1, "a")).schema, "k")


def test_a_writer_that_dies(made, rows, monkeypatch):
    """Between data and manifest nothing is lost or half there; the leftovers go with the next vacuum."""
    made.append(rows((1, "a"), (2, "b")))

    def dies(*_):
        raise RuntimeError

    with monkeypatch.context() as patch:
        patch.setattr(made, "_publish", dies)
        with pytest.raises(RuntimeError):
            made.insert_or_replace(rows((1, "half")))
    assert found(made.read()) == [(1, "a"), (2, "b")] and made.versions() == [0, 1]
    made.insert_or_replace(rows((1, "c")))
    assert made.vacuum(keep=2) == 1 and found(made.read(1)) == [(1, "a"), (2, "b")]
    made.vacuum()
    assert found(made.read()) == [(1, "c"), (2, "b")] and made.versions() == [2]


def test_statistics_add_up(spark, tmp_path):
    """Batches give what one count of all gives; weights don't need the corpus; unknown terms weigh most; no papers, no terms."""
    texts = [(1, "alpha beta beta gamma"), (2, "beta delta 模型 模型"), (3, None), (4, ""), (5, "alpha omega")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    for batch in ("doc_id < 3", "doc_id > 99", "doc_id >= 3"):
        salience.keep_statistics(docs.where(batch), path)
    table = Versions(spark, path)
    assert found(table.read()) == found(salience.term_statistics(docs)) and table.versions() == [0, 1, 2, 3]
    assert dict(map(tuple, table.read().collect())) == {"": 5, "alpha": 2, "beta": 2, "gamma": 1, "delta": 1, "模型": 1, "omega": 1}
    fresh = spark.createDataFrame([(9, "alpha alpha newterm"), (10, None)], "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.w, r["rank"]) for r in salience.tfidf_under(fresh, table.read()).collect()}
    assert got == {(9, "alpha"): (pytest.approx(2 / 3 * (math.log(6 / 3) + 1)), 1), (9, "newterm"): (pytest.approx(1 / 3 * (math.log(6) + 1)), 2)}
    same = salience.tfidf_under(docs, table.read())
    assert found(same) == found(salience.tfidf(docs))
