import pytest
from brute import WORD, components, fill, lower, shingles, similar
from parity import same

from scholia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    assert same(queries.QUERIES[name](spark, small), duck.sql(queries.oracle_sql()[name])) > 0


@pytest.fixture(scope="module")
def docs(duck):
    return {i: (t, lang, source) for i, t, lang, source in duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()}


def test_op1_equals_the_tokenizer(spark, small, docs):
    import hashlib

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    plain.no_truncation()
    plain.no_padding()
    for r in queries.op1_bpe(spark, small).collect():
        ids = plain.encode(docs[r.doc_id][0] or "", add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op2_base_spans(spark, small, docs):
    import hashlib
    import re

    letters = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    keys = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    kinds = {"assign": (rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]+", 24, 0)}
    for r in queries.op2_secrets(spark, small).collect():
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (p, n, g)) in enumerate(kinds.items()) for m in re.finditer(p, docs[r.doc_id][0] or "") if len(m[g]) >= n]
        spans = [x[2] for x in sorted(found)]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(","))


def test_op3_base_and_model(spark, small, docs):
    import math
    import zlib
    from collections import Counter

    counts = Counter()
    for i, (t, _, _) in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*WORD.findall(lower(t)), ""])
    n, v = sum(counts.values()), len(counts)
    got = queries.op3_class_lm(spark, small).collect()
    for r in got:
        tokens = [*WORD.findall(lower(docs[r.doc_id][0])), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4_held_out_accuracy(spark, small, docs):
    held = [r for r in queries.op4_language_id(spark, small).collect() if r.held_out]
    right = [r.lang_pred == docs[r.doc_id][1] for r in held]
    assert len(held) > 30 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_op5_articles(spark, small, duck):
    import html
    import re

    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    for r in queries.op5_main_text(spark, small).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op7_equals_brute_force(spark, small, docs):
    sets = {i: shingles(t) for i, (t, _, _) in docs.items()}
    pairs = similar(sets)
    want = components(sets, pairs)
    assert pairs
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, small).collect()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_op8_targets_and_draws(spark, small, docs):
    sizes = {}
    for t, _, source in docs.values():
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(t or ""))
    want, taken, variance = fill(sizes), {}, {}
    rows = queries.op8_mixing(spark, small).collect()
    for r in rows:
        t, _, source = docs[r.doc_id]
        rate = want[source] / sizes[source] if sizes[source] else 0
        assert r.size == len(WORD.findall(t or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and rate <= 2 + 1e-9
        assert r.taken in (int(rate) * r.size, (int(rate) + 1) * r.size) and r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
        variance[source] = variance.get(source, 0) + r.size**2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(taken[x] - want[x]) <= 4 * variance[x] ** 0.5 + 1e-6 * want[x] for x in want)
    again = queries.op8_mixing(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_op10_equals_brute_force(spark, small, duck):
    import numpy as np

    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    i, j = np.nonzero(unit @ unit.T >= 0.9)
    pairs = [(rows[a][0], rows[b][0]) for a, b in zip(i, j) if a < b]
    links = np.bincount(i, minlength=len(rows)) - 1
    want = components([x for x, _ in rows], pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op10_embedding_dedup(spark, small).collect()}
    assert got == {x: (n, want[x], want[x] == x) for (x, _), n in zip(rows, links.tolist())}
