"""Vector search, lexical search and vector codes against plain versions, on odd rows, hot groups and empty tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import CLASHES

from scholia.llm import lexical_search, queries, vector_codes, vector_search

VECTORS = "vec_id long, embedding array<float>, label int"


def nearest(rows, asked, k):
    """Plain search: {query id: [(id, cosine)]} over rows (id, vector)."""
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)) if i is not None]
    out = {}
    for q, v in good:
        if q in asked:
            found = [(-float(vector_search.cosines(v[None], w[None])[0]), i) for i, w in good if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_op11_recall(spark, small, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = listed(queries.op11_vector_search(spark, small))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    vector = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == pytest.approx(float(vector_search.cosines(vector[q][None], vector[i][None])[0]), abs=1e-15) for i, s in found)


def test_search_recall_in_a_larger_table(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((4000, 32)).astype(np.float32)
    vectors[1000:1400] = vectors[0] + 0.05 * rng.standard_normal((400, 32))  # a hot group of near copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = {i for i in range(0, 4000, 50)}
    want, got = nearest([r[:2] for r in rows], asked, 5), listed(vector_search.nearest(df, df.where("vec_id % 50 = 0")))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def odd_vectors():
    a, b = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, 1.0]
    rows = [(0, a), (50, a), (100, [2.0, 4.0, 6.0, 8.0]), (7, b), (9, None), (150, None), (10, [0.0] * 4), (11, [1.0, None, 0.0, 0.0]), (12, [math.inf, 1.0, 0.0, 0.0]), (13, [math.nan] * 4), (14, []), (None, a), (15, [1.0, 0.0]), (16, [3e38, 3e38, 0.0, 0.0]), (17, [1e-38, 0.0, 0.0, 1e-38]), (7, b), (200, [0.5, 0.5]), (250, [9.0])]
    return rows + [(i, a) for i in range(20, 40)]


def test_search_of_odd_vectors(spark):
    """Ties by id, copies beyond k, scaled copies, other lengths, huge and tiny components, nulls, repeats, clashing names."""
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, *["x"] * len(CLASHES)) for i, v in rows], "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in CLASHES))
    got = listed(vector_search.nearest(df, df.where("vec_id % 50 = 0")))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = {q: v for q, v in nearest(single, {0, 50, 100, 150, 200, 250}, 5).items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert 250 not in got and got[200] == [(15, pytest.approx(math.sqrt(0.5)))]
    assert vector_search.nearest(df.limit(0), df).count() == 0
    assert vector_search.nearest(df, df.limit(0)).count() == 0


def test_search_of_queries_outside_the_table(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 0.0, float(i % 7)], 0) for i in range(300)], VECTORS)
    asked = spark.createDataFrame([(1000, [2.0, 1.0, 0.0, 3.0], 0), (5, [0.0, -1.0, 4.0, 0.0], 0)], VECTORS)
    got = listed(vector_search.nearest(df, asked, k=3))
    assert set(got) == {1000, 5} and all(len(v) == 3 for v in got.values()) and 5 not in [i for i, _ in got[5]]


def test_large_buckets_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + 0.01 * rng.standard_normal(8)).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = df.where("vec_id % 5 = 0")
    whole = listed(vector_search.nearest(df, asked))
    monkeypatch.setattr(vector_search, "BLOCK", 50)
    assert listed(vector_search.nearest(df, asked)) == whole


def test_probed_codes_are_those_of_least_loss():
    rng = np.random.default_rng(2)
    unit = rng.standard_normal((20, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hashes = [16, 4]
    code, loss = vector_search.probed(unit, 0, hashes, 32 * 8)
    assert (code[:, 0] == vector_search.codes(unit, 0, hashes)).all() and (np.diff(loss, axis=1) >= 0).all()
    assert all(len(set(c)) == 32 * 8 for c in code.tolist())
    few = vector_search.probed(unit, 0, hashes, 10)
    assert np.allclose(few[1], loss[:, :10])
    assert np.allclose(np.linalg.norm(vector_search.hadamard(unit), axis=1), 1)


def plain_rank(docs, items, k):
    found = {n: lexical_search.terms(t) for n, (_, t) in enumerate(docs)}
    total, all_terms = sum(bool(w) for w in found.values()), sum(map(len, found.values()))
    having, counts = Counter(t for w in found.values() for t in set(w)), {n: Counter(w) for n, w in found.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(lexical_search.terms(text))
    out = {}
    for item, own in asked.items():
        scored = []
        for n, c in counts.items():
            m = 50 + 50 * len(found[n]) * total // all_terms if all_terms else 0
            score = sum(lexical_search.weight(total, having[t]) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, docs[n][0] is None, docs[n][0]))
        if scored:
            out[item] = [(i, -s) for s, _, i in sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k]]
    return out


def rank_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r["rank"])):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 40, 200])))) for i in range(n)]


def test_ranks_equal_a_plain_search(spark, monkeypatch):
    """Many shards, many blocks of queries, seeds that raise the threshold."""
    docs, rng = corpus(1500), random.Random(1)
    docs += [(2000 + i, docs[3][1]) for i in range(100)]  # more ties than k
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.choice([1, 3, 30])))) for i in range(30)]
    items.append((99, docs[3][1]))
    for name, value in (("SHARD", 5000), ("QUERIES", 10), ("SEEDING", 4), ("STRIDE", 16)):
        monkeypatch.setattr(lexical_search, name, value)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert rank_lists(lexical_search.rank(d, q, k=20)) == plain_rank(docs, items, 20)


def test_ranks_of_odd_texts(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "ONE two, three"), (2, None), (3, ""), (None, "日本語 alpha1"), (4, "nothing-of-this zzzz"), (5, "é\x85ß"), (1, "five")]
    asked = spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in items], "item_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    want = plain_rank(docs, items, 4)
    got = rank_lists(lexical_search.rank(odd, asked, k=4))
    assert got == want and 2 not in got and None in got
    assert lexical_search.rank(none, asked).count() == 0 and lexical_search.rank(odd, asked.limit(0)).count() == 0


def test_blocks_cost_least(monkeypatch):
    """Against all ways to cut short lists at multiples of the cell."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lexical_search, "CELL", 2)
    sizes = [1, 2, 7, 12, 15, 4]
    gain = rng.integers(1, 1000, sum(sizes))
    begin = np.r_[0, np.cumsum(sizes)]

    def cost(x, ends):
        starts = [0, *ends[:-1]]
        return sum(max(x[a:b]) * (b - a) - sum(x[a:b]) for a, b in zip(starts, ends)) + len(ends) * lexical_search.CUT * x.sum() / len(x)

    for i, ends in enumerate(lexical_search.block_ends(gain, begin)):
        x = gain[begin[i] : begin[i + 1]]
        inner = list(range(2, len(x), 2))
        ways = ([e for k, e in enumerate(inner) if mask >> k & 1] + [len(x)] for mask in range(1 << len(inner)))
        assert ends[-1] == len(x) and cost(x, ends.tolist()) == pytest.approx(min(cost(x, w) for w in ways))


def test_search_passes_blocks_over():
    """With a threshold only some documents are looked at, and none that belongs in the list is lost."""
    rng = np.random.default_rng(4)
    docs, terms = 4000, 6
    hold = [np.sort(rng.choice(docs, n, replace=False)) for n in (3000, 2000, 500, 100, 40, 10)]
    term, doc = np.repeat(np.arange(terms), [len(h) for h in hold]), np.concatenate(hold)
    tf, length = rng.integers(1, 9, len(doc)), rng.integers(20, 400, docs)
    weights = np.array([lexical_search.weight(docs, len(h)) for h in hold])
    shard = lexical_search.Shard(length, term, doc, tf, weights, docs, int(length.sum()))
    plain = np.bincount(doc, weights[term] * lexical_search.impacts(tf, length[doc], docs, int(length.sum())), docs)
    want = np.lexsort((np.arange(docs), -plain))[:10]
    for floor in (0, int(plain[want[-1]]) - 1):
        keep, scores = shard.top(list(range(terms)), 10, floor)
        order = np.lexsort((keep, -scores))
        assert keep[order].tolist() == want.tolist() and (scores[order] == plain[want]).all()


def plain_codes(rows, entries=256, rounds=4):
    """Lloyd's rounds in whole numbers over rows (id, vector, label)."""
    good = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // 4
    parts = [[r[1][p * width : (p + 1) * width] for r in good] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for number in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda e: (far(x, b[e]), e)) for x in part] for part, b in zip(parts, books)]  # noqa: B023
        if number < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    own = [x for x, c in zip(parts[p], codes[p]) if c == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    error = [sum(far(parts[p][n], books[p][codes[p][n]]) for p in range(4)) for n in range(len(good))]
    per = Counter()
    for (_, _, label), e in zip(good, error):
        per[label] += e
    return sorted((str(i), "".join(f"{codes[p][n]:02x}" for p in range(4)), error[n], per[label]) for n, (i, _, label) in enumerate(good)), books


def test_codes_equal_plain_rounds(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i * 3 % 401, [rng.gauss(0, 1) + (i % 5) for _ in range(8)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(i, rows[5][1], 9) for i in range(500, 560)] + [(5, [0.0] * 8, None), (-3, [1e9, -1e9] * 4, 1)]  # copies, a repeated id
    rows[-1] = (-3, [100.0, -100.0] * 4, 1)
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    monkeypatch.setattr(vector_codes, "STEP", 16)
    want, books = plain_codes(rows)
    out = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out) == want
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(vector_codes.codebooks_text(np.array(books)).encode()).hexdigest()}


def test_codes_of_odd_vectors(spark):
    """Null, empty, odd lengths, other lengths, nulls and non-finite components go; null ids stay; few vectors are all entries."""
    a = [1.0, 2.0, 3.0, 4.0]
    bad = [(9, None), (10, [1.0, None, 0.0, 0.0]), (11, [math.inf, 1.0, 0.0, 0.0]), (12, [math.nan] * 4), (1, []), (2, [1.0, 2.0, 3.0]), (13, [1.0] * 8)]
    good = [(3, a), (3, a), (4, [0.0] * 4), (None, [5.0, -6.0, 7.0, 8.5]), (5, [-0.0001, 3.9999, 1e30, -1e30])]
    df = spark.createDataFrame([(i, v, *["y"] * len(CLASHES)) for i, v in bad + good], "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in CLASHES))
    out = vector_codes.compress(df).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(str(i) for i, _ in good)
    assert all(r.error == 0 and r.label_error == 0 for r in out)
    assert vector_codes.compress(df.limit(0)).count() == 0 and vector_codes.compress(df.where("vec_id in (9, 12)")).count() == 0


def test_heaps_pop_few_and_miss_none():
    """Parts that a round leaves alone keep their nearest entry; most are left alone once entries rest."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (32, 6))
    parts = np.concatenate([c + rng.integers(-60, 60, (200, 6)) for c in centres]).astype(np.int32)
    book = (centres + rng.integers(-40, 40, centres.shape)).astype(np.int64)
    entry, near, next_ = vector_codes.scan(parts, book)
    key, drift = np.sqrt(next_) - np.sqrt(near), np.zeros(32)
    for _ in range(3):
        after = np.array([parts[entry == e].sum(0) // max(1, (entry == e).sum()) if (entry == e).any() else book[e] for e in range(32)])
        move = np.sqrt(((after - book) ** 2).sum(1).astype(float))
        book, drift = after, drift + move + vector_codes._largest_other(move[None])[0]
        seen = vector_codes.Heaps(entry, key, 32).popped(drift)
        exact = vector_codes.scan(parts, book)
        rest = np.setdiff1d(np.arange(len(parts)), seen)
        assert (exact[0][rest] == entry[rest]).all() and len(seen) < len(parts) / 2
        entry[seen] = exact[0][seen]
        key[seen] = np.sqrt(exact[2][seen]) - np.sqrt(exact[1][seen]) + drift[entry[seen]]
