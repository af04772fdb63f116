import random
import re

import pytest
from pyspark.sql import functions as F

from scholia.operators import rollup, salience, score, sections

BODY = " and a reasonably long body of text that goes on for a while."
PAPERS = {
    "en": f"Abstract\nWe propose a novel idea{BODY}\nKeywords: one, two three\n2 Method\nThe model{BODY}\n3 Results\nIt takes 15 ms and 3.5 dB{BODY}\n4 Conclusion\nIt takes 15 ms{BODY}\n",
    "zh": "摘要：本文提出了一种全新的方法，用来解决一个非常困难的问题，并且效果很好，值得推广应用。\n关键词：甲，乙，丙丁戊\n2 研究方法\n我们的方法由若干部分组成，每一部分都有详细的说明，此处略去不表，读者可自行查阅资料。\n3 实验结果\n准确率达到95.5%，延迟15 ms，远高于其他方法，详细的数据列在后面的表格里面供大家参考。\n4 结论\n综上所述，方法有效，准确率达到95.5%，今后会继续改进这一方法并推广到更多的场景之中。\n",
    "ja": "要旨：新しい手法を提案する。これは難しい問題を解決するための方法であり、とても良い結果が得られた。\nキーワード：機械学習，検出\n2 提案手法\n提案手法は複数の部分から構成される。それぞれの部分について詳しく説明する。ここでは省略する。\n3 実験結果\n精度は95.5%であった。従来の手法よりも高い。詳しい結果は表に示す。表は後に示すことにする。\n4 結論\n本稿では新しい手法を提案した。今後は他の問題にも適用する予定である。さらに改良を進める。\n",
    "ko": "초록: 새로운 방법을 제안한다. 이 방법은 어려운 문제를 해결하기 위한 것이며 좋은 결과를 얻었다.\n키워드: 기계 학습, 검출\n2 제안 방법\n제안하는 방법은 여러 부분으로 구성된다. 각 부분에 대해 자세히 설명한다. 여기서는 생략한다.\n3 실험 결과\n정확도는 95.5%였다. 기존 방법보다 높다. 자세한 결과는 표에 나타낸다. 표는 뒤에 나온다.\n4 결론\n본 논문에서는 새로운 방법을 제안하였다. 앞으로 다른 문제에도 적용할 예정이다. 더 개선한다.\n",
    "de": f"Zusammenfassung\nWir schlagen ein neues Verfahren vor{BODY}\nSchlüsselwörter: eins, zwei\n2 Methodik\nDas Verfahren{BODY}\n3 Ergebnisse\nDie Genauigkeit war 95.5%{BODY}\n4 Fazit\nEs geht{BODY}\n",
}


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def grades(spark, mode="teacher", subject="general", **texts):
    return {r.doc_id: r for r in score.score_all(docs(spark, **texts), mode, subject).collect()}


def test_sections_in_five_languages(spark):
    for r in sections.extract_sections(docs(spark, **PAPERS)).collect():
        assert all(r[n] for n in sections.NAMES), (r.doc_id, [n for n in sections.NAMES if not r[n]])
        assert len(r.abstract) <= 600
    en = sections.extract_sections(docs(spark, en=PAPERS["en"])).first()
    assert en.abstract.startswith("We propose") and "Keywords" not in en.abstract


def test_full_structure(spark):
    assert all(r.structure == 25 for r in grades(spark, **PAPERS).values())


def test_breadth_beats_stuffing(spark):
    stuffed = "model framework model framework. " * 20
    broad = "model. learning rate. dataset. accuracy."
    got = grades(spark, subject="cs", stuffed=stuffed, broad=broad)
    assert got["broad"].method > got["stuffed"].method and got["broad"].covered == 4


def test_profiles_and_subjects(spark):
    text = PAPERS["en"] + " cohort of patients with p-value and mortality outcome. " * 3
    totals = [grades(spark, m, "medical", a=text)["a"].total for m in ("teacher", "expert", "professor")]
    assert totals == sorted(totals, reverse=True) and totals[2] <= 65
    assert grades(spark, subject="medical", a=text)["a"].method > grades(spark, subject="civil", a=text)["a"].method
    assert grades(spark, "nobody", "nothing", a=text)["a"].mode == "teacher"


def test_weak_and_short(spark):
    got = grades(spark, subject="materials", weak="Nothing to see.", empty="")
    assert got["weak"].method <= 12 and got["weak"].conf_level in ("低", "中")
    assert got["empty"].total == 0


def test_null_text(spark):
    assert score.score_all(spark.createDataFrame([(1, None)], "doc_id int, text string")).first().total == 0


def test_numbers(spark):
    got = grades(spark, "professor", a=PAPERS["en"])["a"]
    assert (got.n_expr, got.n_conc, got.n_cross) == (2, 1, 1)


def test_salience_bounds_and_report(spark):
    rows = docs(spark, **PAPERS)
    scored, hits = score.score_all(rows, "teacher", "cs"), salience.salience(rows)
    found = hits.collect()
    assert found and all(0.05 <= r.salience <= 0.95 for r in found)
    keep = [r.salience for r in found if r.action == "keep"]
    assert sum(keep) / len(keep) > 0.5
    assert all("Core passages" in r.report for r in rollup.report_text(scored, hits).where("doc_id = 'en'").collect())
    assert {r.level for r in rollup.overview(scored, hits).collect()} <= {"优秀", "良好", "中等", "待改进"}


@pytest.mark.parametrize("n, rate, want", [(0, 0.5, 0.0), (1, 0.5, 0.5), (2, 0.5, 0.75)])
def test_saturation(spark, n, rate, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(score.saturate(F.lit(n), rate)).first()[0] == pytest.approx(want)


def test_lexicon_from_a_file(spark, tmp_path):
    from scholia.functions import lexicon

    path = tmp_path / "lexicon.json"
    path.write_text('{"innovation": {"teacher": ["zebra"], "expert": [], "professor": []}}')
    words = lexicon.load(f"file://{path}", spark)
    assert words["innovation"]["teacher"] == ["zebra"] and words["rubrics"] == lexicon.RUBRICS
    assert score.score_all(docs(spark, a="a Zebra ran"), lexicon=words).first().innovation_hits == 1


def test_looks_for_headings_lose_no_section(spark):
    """Where a pattern finds something, one of the letters or words that it is guarded by is there."""
    assert all(len(sections.HOLDS[n]) == len(sections.HEADINGS.get(n, [0])) for n in sections.NAMES)
    rng, pieces = random.Random(9), []
    for own in sections.HEADINGS.values():
        for _, words in own:
            pieces += [x for x in re.split(r"[()|?:\[\]+*\\{}]|s[*+]", words) if x]
    changed = [str, str.upper, str.lower, lambda h: h.replace("i", "İ"), lambda h: h.replace("i", "ı"), lambda h: h.replace("s", "ſ"), " ".join, lambda h: h + " " + rng.choice(pieces)]
    texts = [rng.choice(["", "1 ", "## ", "IV. "]) + rng.choice(changed)(h) + rng.choice(["\n", ": \n", "：", " — "]) + "body of text that has more than thirty characters" for h in pieces * 4]
    docs_ = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("low", sections.folded(F.col("text")))
    for name, own in sections.HEADINGS.items():
        for heading, held in zip(own, sections.HOLDS[name], strict=True):
            guard = F.exists(F.array(*[F.lit(w) for w in held.split("|")]), lambda w: F.contains("low", w))
            assert docs_.where(F.rlike("text", F.lit("(?iUdm)" + sections.heading(*heading))) & ~guard).count() == 0, heading


def test_texts_are_lower_cased_once(spark):
    plan = score.score_all(docs(spark, **PAPERS))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower(" not in plan.lower()
