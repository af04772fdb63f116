"""Han words: learned from composed texts whose words are known, readings against plain code, weights and salience of words."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scholia.functions import fixed
from scholia.operators import salience, segment
from scholia.plans import catalog
from scholia.sources import papers as sources

HAN = re.compile("[一-鿿]+")


def plain_read(run, lexicon):
    """The most probable reading of a run; of equal ones that whose last word is longest."""
    logs = {segment.unpacked(w): p for w, p in zip(lexicon.words.tolist(), lexicon.logs.tolist())}
    best = [(0.0, 0)]
    for e in range(1, len(run) + 1):
        ways = []
        for n in range(1, min(segment.LONGEST, e) + 1):
            w = run[e - n : e]
            log = logs.get(w, lexicon.unknown if n == 1 else None)
            if log is not None:
                ways.append((best[e - n][0] + log, n))
        best.append(max(ways))
    out, e = [], len(run)
    while e:
        out.append(run[e - best[e][1] : e])
        e -= best[e][1]
    return out[::-1]


def plain_tokens(text, lexicon):
    out = []
    for t in re.findall("[一-鿿]+|(?:(?![一-鿿_])\\w)+", (text or "").lower()):
        out += plain_read(t, lexicon) if HAN.match(t) else [t]
    return out


def spans(words):
    out, at = set(), 0
    for w in words:
        out.add((at, at + len(w)))
        at += len(w)
    return out


@pytest.fixture(scope="module")
def known():
    """(texts, words of each): sentences of 800 words of one to four characters, some far more frequent than others."""
    rng = random.Random(1)
    chars = [chr(0x4E00 + i * 13) for i in range(300)]
    vocabulary = ["".join(rng.choices(chars, k=rng.choice([1, 2, 2, 2, 3, 4]))) for _ in range(800)]
    weights = [1 / (k + 3) for k in range(800)]
    said = [[rng.choices(vocabulary, weights, k=rng.randint(4, 15)) for _ in range(20)] for _ in range(200)]
    return ["。".join("".join(s) for s in doc) for doc in said], [[w for s in doc for w in s] for doc in said]


@pytest.fixture(scope="module")
def texts(spark, known):
    return spark.createDataFrame(list(enumerate(known[0])), "doc_id long, text string")


@pytest.fixture(scope="module")
def lexicon(texts):
    return segment.learn(texts)


def test_known_words_are_found(texts, known, lexicon):
    right = made = true = 0
    for r in segment.with_words(texts, "text", "t", lexicon).collect():
        got, want = spans(r.t), spans(known[1][r.doc_id])
        right, made, true = right + len(got & want), made + len(got), true + len(want)
    assert right / made > 0.97 and right / true > 0.97


def test_words_and_their_figures(texts, known):
    """Counts, cohesion and entropies against plain counting."""
    runs = [r for t in known[0] for r in HAN.findall(t)]
    n = Counter(r[i : i + k] for r in runs for k in range(1, segment.LONGEST + 1) for i in range(len(r) - k + 1))
    total = sum(c for g, c in n.items() if len(g) == 1)
    want, firm = {}, {}
    for g, c in sorted(n.items(), key=lambda x: len(x[0])):
        if len(g) > 1 and c >= segment.LEAST and (len(g) == 2 or (g[1:] in firm and g[:-1] in firm)):
            least = min(math.log(c * total / (n[g[:k]] * n[g[k:]])) for k in range(1, len(g)))
            if least >= segment.COHESION:
                firm[g] = least
    for g in firm:
        sides = [Counter(), Counter()]
        for r in runs:
            at = r.find(g)
            while at >= 0:
                sides[0][r[at - 1 : at]] += 1
                sides[1][r[at + len(g) : at + len(g) + 1]] += 1
                at = r.find(g, at + 1)
        free = [-sum(x / n[g] * math.log(x / n[g]) for x in s.values()) for s in sides]
        if min(free) >= segment.FREEDOM:
            want[g] = (n[g], firm[g], *free)
    got = {r.word: (r.n, r.cohesion, r.left_entropy, r.right_entropy) for r in segment.words(texts).collect()}
    assert set(got) == set(want) and len(got) > 300
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def test_readings_equal_a_plain_search(lexicon):
    rng = random.Random(2)
    chars = [segment.unpacked(w)[0] for w in lexicon.words.tolist()[:200]] + ["龥", "一"]
    runs = ["".join(rng.choices(chars, k=n)) for n in (1, 2, 3, 4, 5, 9, 40, 400)]
    text = "。".join(runs) + "x" + runs[3]
    units = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    starts, lengths = segment.read(units, lexicon)
    assert [text[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())] == [w for r in [*runs, runs[3]] for w in plain_read(r, lexicon)]


def test_ties_take_the_longest_last_word():
    word = np.sort(np.array([segment.packed(w) for w in ("一二", "二三", "一", "三")], np.int64))
    lexicon = segment.Lexicon(word, np.full(4, -1.0), -9.0)
    assert segment.read(np.frombuffer("一二三".encode("utf-16-le"), np.uint16), lexicon)[1].tolist() == [1, 2]


def test_numbers_of_words(spark):
    words = ["一", "龥", "中国", "龥龥龥", "一一龥一", "龥一二三"]
    assert [segment.unpacked(segment.packed(w)) for w in words] == words
    rows = spark.createDataFrame([(segment.packed(w),) for w in words], "w long")
    assert [r[0] for r in rows.select(segment.spelled(rows.w)).collect()] == words


def test_pieces_keep_every_string(monkeypatch, known):
    """Texts cut into pieces have the same strings and neighbours as whole ones."""
    texts = [*known[0][:10], None, "", "no Han", "一二" * 500 + "。三", "\U00020000一\U00020000"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    some = np.unique([segment.packed(known[0][0][i : i + 2]) for i in range(30)])

    def totals(run, *names):
        out = Counter()
        for b in run([batch]):
            for row in b.to_pylist():
                out[tuple(row[k] for k in names)] += row["n"]
        return out

    runs = [(segment._counts(1, None), ["word"]), (segment._counts(3, np.ones(segment.SLOTS, bool)), ["word"]), (segment._sides(some), ["word", "side", "beside"])]
    whole = [totals(r, *names) for r, names in runs]
    monkeypatch.setattr(segment, "PIECE", 16)
    monkeypatch.setattr(segment, "HELD", 50)
    assert [totals(r, *names) for r, names in runs] == whole and all(whole)


def test_odd_texts(spark, lexicon):
    """Null and empty texts have no tokens; other scripts, marks and unknown characters are read; no texts give no words."""
    rows = [(1, None), (2, ""), (3, "ABC déf 42_x"), (4, "龥"), (5, "a一b"), (6, "。！ \n"), (7, "\U00020000一𝟙")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in segment.with_words(df, "text", "t", lexicon).collect()}
    assert got == {1: [], 2: [], 3: ["abc", "déf", "42", "x"], 4: ["龥"], 5: ["a", "一", "b"], 6: [], 7: ["\U00020000", "一", "𝟙"]}
    assert segment.words(df.limit(0)).count() == 0 and segment.words(df).count() == 0
    none = segment.learn(df.limit(0), known={"深度学习": 9, "toolong一二三四五": 3, "abc": 4})
    assert len(none) == 1 and plain_tokens("深度学习好", none) == ["深度学习", "好"]
    assert segment.with_words(df.limit(0), "text", "t", none).count() == 0


def test_known_words_join_the_lexicon(texts, known):
    word = known[0][0][:4]
    taught = segment.learn(texts, known={word: 10**9})
    assert plain_read(word + word, taught) == [word, word]


def test_query_equals_plain_reading(spark, small):
    docs = sources.han_documents(spark, small)
    lexicon = segment.learn(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = catalog.QUERIES["han_tokens"](spark, small).collect()
    assert len(got) == len(text)
    for r in got:
        words = plain_tokens(text[r.doc_id], lexicon)
        assert r.n_tokens == len(words) and r.tokens_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_weights_and_salience_of_words(spark, small):
    """Hits of Chinese papers, whose weights come from words, against plain code."""
    docs = sources.papers(spark, small)
    lexicon = segment.learn(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    content = lambda tokens: [t for t in tokens if len(t) > 1 and t not in fixed.STOPWORDS]
    words = {i: content(plain_tokens(t, lexicon)) for i, t in text.items()}
    df = Counter(w for own in words.values() for w in set(own))
    weights = {}
    for i, own in words.items():
        n = Counter(own)
        each = {w: round(c / len(own) * (math.log((len(text) + 1) / (df[w] + 1)) + 1), 9) for w, c in n.items()}
        weights[i] = dict(sorted(each.items(), key=lambda x: (-x[1], x[0]))[: fixed.TOP_TERMS])
    got = {}
    for r in catalog.salience.tfidf(docs, lexicon=lexicon).collect():
        got.setdefault(r.doc_id, {})[r.term] = r.w
    assert {i: w for i, w in weights.items() if w} == {i: {t: pytest.approx(x) for t, x in w.items()} for i, w in got.items()}
    rows = salience.salience(docs, lexicon=lexicon).collect()
    chinese = [r for r in rows if HAN.search(r.hit)]
    assert len(chinese) > 20 and any(len(t) > 2 for r in chinese for t in plain_tokens(r.hit, lexicon))
    for r in rows:
        tokens = plain_tokens(r.hit, lexicon)
        own, peak = content(tokens), max(weights[r.doc_id].values(), default=1)
        mean = sum(weights[r.doc_id][t] / peak if t in weights[r.doc_id] else fixed.UNKNOWN_WORD for t in own) / len(own) if own else 0
        assert r.f_tfidf == pytest.approx(min(1, mean), abs=1e-6) and r.f_density == pytest.approx(len(own) / max(1, len(tokens)), abs=1e-6)


def test_readings_at_many_lengths_and_ties():
    rng = random.Random(12)
    vocabulary = list({"".join(rng.choices("一二三四五", k=rng.randint(1, 4))) for _ in range(60)})
    words = np.array(sorted(map(segment.packed, vocabulary)), np.int64)
    lexicon = segment.Lexicon(words, np.round(np.log(np.array([rng.random() for _ in vocabulary])), 1), -3.0)
    runs = ["".join(rng.choices("一二三四五六", k=rng.randint(1, 40))) for _ in range(200)]
    starts, lengths = segment.read(np.frombuffer("\n".join(runs).encode("utf-16-le"), np.uint16), lexicon)
    text = "\n".join(runs)
    assert [text[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())] == [w for r in runs for w in plain_read(r, lexicon)]


def test_words_are_looked_up_in_a_table():
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(-(1 << 63), 1 << 62, 5000))
    places = segment.Places(words)
    asked = np.r_[words[::3], rng.integers(-(1 << 63), 1 << 62, 3000), 0, -1]
    known = {w: k for k, w in enumerate(words.tolist())}
    assert places.of(asked).tolist() == [known.get(w, -1) for w in asked.tolist()]
    assert segment.Places(words[:0]).of(asked).max() == -1
    assert segment.Lexicon(words[:0], np.zeros(0), -1.0).log(asked).max() == -np.inf


def test_words_are_cut_from_the_bytes_of_their_runs():
    lexicon = segment.Lexicon(np.array(sorted(map(segment.packed, ["一二", "三", "四五六"])), np.int64), np.full(3, -1.0), -9.0)
    flat = pa.array(["skipped", "ab", "一二三", "ñandú", "四五六一二", "한국", "𠀀x", "三"]).slice(1)
    tokens, ends = segment._in_words(flat, lexicon)
    assert tokens.to_pylist() == ["ab", "一二", "三", "ñandú", "四五六", "一二", "한국", "𠀀x", "三"]
    assert ends.tolist() == [0, 1, 3, 4, 6, 7, 8, 9]
    assert segment._in_words(flat.slice(0, 0), lexicon)[1].tolist() == [0]


def test_composed_texts_by_words_between_blanks():
    composed = sources._Composed()
    for said in ("", "word", "a.b", "end.", "..", "!a;b?", "x.y."):
        plain = ""
        for w in re.findall(r"[a-z]+|[.!?;]", said):
            x = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            plain += "。" if w in ".!?;" else "".join(sources.HAN[(x >> 2 + 10 * k) % 1024] for k in range((1, 2, 2, 3)[x % 4]))
        assert composed[said] == composed[said] == plain
