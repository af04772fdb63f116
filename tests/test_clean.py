from pyspark.sql import functions as F

from scholia.operators import clean


def gate(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    return [r.ok for r in rows.select("k", clean.quality_ok(F.col("text")).alias("ok")).orderBy("k").collect()]


def test_quality_gate(spark):
    good = "A plain sentence with words, numbers 12 and stops. " * 3
    garbled = " ".join(f"(cid:{k})" for k in range(300))
    assert gate(spark, good, "这是一段正常的中文，带有标点。", garbled, "➐➑➒" * 100, "", " \n\t", None, good * 5 + "(cid:3)") == [True, True, False, False, False, False, False, True]


def test_repeated_lines():
    unique = [f"line number {k} says something" for k in range(100)]
    furniture = [x for k, line in enumerate(unique) for x in ([line, "Journal of Tests", "page foot"] if k % 10 == 0 else [line])]
    assert clean.strip_repeated("\n".join(furniture)).split("\n") == unique
    heavy = "\n".join(["a", "b", "c"] * 10)
    assert clean.strip_repeated(heavy) == heavy
    assert clean.strip_repeated("\n".join(unique)) == "\n".join(unique)
    assert clean.strip_repeated("no break") == "no break"
    assert clean.strip_repeated(None) is None
    marked = "\n".join([*unique, "download here", "Download here", "download here"])
    assert "download here" in clean.strip_repeated(marked)
    assert "download here" not in clean.strip_repeated(marked, aggressive=True)


def test_reflow():
    assert clean.reflow("a sen-\ntence that\nwraps. \nNext one\n\n1. Heading\nbody") == "a sentence that wraps.\nNext one\n1. Heading body"
    assert clean.reflow("中文\n换行") == "中文换行"
    assert clean.reflow("a\r\nb\rc") == "a b c"
    assert clean.reflow("") == ""


def test_chunks():
    text = "\n\n".join("x" * n for n in (10, 10, 30, 5))
    assert clean.pack_paragraphs(text, 25) == ["x" * 10 + "\n\n" + "x" * 10, "x" * 30, "x" * 5]
    assert "\n\n".join(clean.pack_paragraphs(text, 17)) == text
    assert clean.pack_paragraphs("", 10) == [""]
    assert clean.pack_paragraphs(None) == []


def test_sentences(spark):
    rows = spark.createDataFrame([("One is here. Two is\nthere! 三。四；five 3.14 stays",)], "t string")
    assert rows.select(clean.sentences(F.col("t")).alias("s")).first().s == ["One is here.", "Two is there!", "三。", "四；", "five 3.14 stays"]


def test_reading_order(spark):
    box = lambda x, y: [[float(x), float(y)], [x + 80.0, float(y)], [x + 80.0, y + 10.0], [float(x), y + 10.0]]
    two = [(box(400, 0), "r1", 0.9), (box(0, 20), "l2", 0.9), (box(0, 0), "l1", None), (box(400, 20), "r2", 0.9), (box(0, 40), "noise", 0.1), (box(0, 41), "", 0.9), (box(0, 42), None, 0.9)]
    one = [(box(10, 20), "b", 1.0), (box(10, 0), "a", 1.0), (box(10, 0), "a again", 1.0)]
    flat = [([[0.0, 9.0], [5.0, 9.0]], "y", 1.0), ([[6.0, 7.0], [9.0, 7.0]], "x", 1.0)]
    rows = spark.createDataFrame([(0, 600.0, two), (1, 1000.0, one), (2, 100.0, []), (3, None, None), (4, 1000.0, flat)], "page_id int, width double, tokens array<struct<points: array<array<double>>, text: string, score: double>>")
    got = {}
    for r in clean.ocr_reading_order(rows).orderBy("page_id", "line").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {0: ["l1", "l2", "r1", "r2"], 1: ["a", "a again", "b"], 4: ["y", "x"]}
