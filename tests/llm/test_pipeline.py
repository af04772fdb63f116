"""Each stage against a plain version, on its own input."""

import pytest
from brute import components, lower, shingles, similar

import corpus_pipeline
from scholia.llm import language_id, mixing
from scholia.llm.queries import vocabulary
from scholia.llm.scratch import Scratch


@pytest.fixture(scope="module")
def steps(spark, small):
    scratch = Scratch(spark, "steps")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], small), name))
    return out


def test_stages_keep_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(x.columns == steps[0].columns for x in steps[:-1])


def test_language_keeps_clean_documents(steps):
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in steps[0].where("text rlike '[A-Za-z]'").collect()}


def test_language_rejects_what_no_language_explains(spark, small):
    """Texts of several learned languages and of marks stay; unlearned languages, markup and random letters go."""
    import random

    rng = random.Random(4)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    long = [r for r in docs.where("length(text) > 300").orderBy("doc_id").collect()]
    first = {lang: next(r.text[:300] for r in long if r.lang == lang) for lang in sorted({r.lang for r in long if r.lang})}
    stay = [" ".join(w for pair in zip(first[a].split(), first[b].split()) for w in pair) for a in first for b in first if a < b]
    stay += [" | ".join(first["en"].split()), first["en"].upper().replace(" ", "!! ")]
    draw = lambda letters, size, n: " ".join("".join(rng.choices(letters, k=size)) for _ in range(n))
    go = [
        "Pemerintah kota akan membangun jalan baru yang menghubungkan pelabuhan dengan pusat perdagangan agar barang dapat dikirim lebih cepat",
        "Hallitus aikoo rakentaa uuden tien joka yhdistää sataman kaupungin keskustaan jotta tavarat voidaan kuljettaa nopeammin kaikkialle",
        '<div class="row"><span id=nav><a href=index.html>x</a></span><table><tr><td>y</td></tr></table><br/></div>' * 5,
        "Правительство планирует построить новую дорогу", draw("0123456789abcdef", 32, 10), draw("abcdefghijklmnopqrstuvwxyz", 7, 40),
    ]
    model = language_id.fit(docs)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(stay + go)], "doc_id long, text string")
    got = {r.doc_id: r.lang_accepted for r in language_id.identify(rows, model).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(stay) + [False] * len(go)


def test_exact(steps):
    best = {}
    for r in steps[1].collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(best.values())


def test_near(steps):
    sets = {r.doc_id: shingles(r.text) for r in steps[2].collect()}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(set(components(sets, similar(sets)).values()))


def test_mix(steps):
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(steps[3]).collect()}
    counts = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in plan.items() if n}


def test_encoded(steps):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    plain.no_truncation()
    plain.no_padding()
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    assert all(list(r["ids"]) == plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r["ids"]) for r in rows)


def test_empty(spark, steps, small):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_odd_rows(spark, odd, small):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() > 0


def test_run(spark, small, steps):
    assert corpus_pipeline.run(spark, small).count() == steps[-1].count()
    assert corpus_pipeline.ORACLE_SQL is None
