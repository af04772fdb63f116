import io
import zipfile

from scholia.sources import extract, papers, sinks


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text, kept as it is")
    (tmp_path / "b.MD").write_text("  \n")
    (tmp_path / "c.docx").write_bytes(docx("One paragraph here.", "And another one."))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"x")
    rows = extract.extract_files(papers.read_binaries(spark, f"file://{tmp_path}")).collect()
    assert {r.path[-5:].lstrip("/"): (r.text, r.extractor) for r in rows} == {
        "a.txt": ("plain text, kept as it is", "plain"), "b.MD": ("", ""), ".docx": ("", ""), "e.bin": ("", ""),
    } | {r.path[-5:].lstrip("/"): (r.text, r.extractor) for r in rows if r.path.endswith("docx")}
    assert ("One paragraph here.\nAnd another one.", "docx") in {(r.text, r.extractor) for r in rows}


def test_chain_takes_the_first_that_passes():
    chain = {"pdf": [("bad", lambda c: 1 / 0), ("garbled", lambda c: "(cid:1)" * 50), ("good", lambda c: "readable words"), ("late", lambda c: "other words")]}
    assert extract.text_of("pdf", b"", chain=chain) == ("readable words", "good")
    assert extract.text_of("pdf", None, chain=chain) == ("", "")


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("1_a", 1, "{}", "{}"), ("2_b", 2, "{}", "{}")], sinks.HISTORY)
    sinks.append_history(rows.limit(1), path)
    sinks.append_history(rows.where("id = '2_b'"), path)
    kept = sinks.read_history(spark, path)
    assert kept.count() == 2 and sinks.delete_records(kept, ["1_a"]).count() == 1 and sinks.delete_records(kept).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text('{"id": "17_x", "filename": "f"}')
    (tmp_path / "old" / "b.json").write_text("not json")
    (tmp_path / "old" / "c.json").write_text('{"id": "1_a", "timestamp": 5}')
    assert [(r.id, r.timestamp) for r in sinks.import_history(spark, str(tmp_path / "old"), kept).collect()] == [("17_x", 17)]


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("i", "x", "o", "p")], "instruction string, input string, output string, _paper string")
    papers.write_jsonl(rows, str(tmp_path / "out"))
    assert papers.read_samples(spark, str(tmp_path / "out")).collect()[0].asDict() == {"instruction": "i", "input": "x", "output": "o"}


def test_texts(spark, tmp_path):
    sinks.write_texts(spark.createDataFrame([("a\nb",)], "report string"), str(tmp_path / "t"))
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.txt").write_text("one\ntwo")
    assert papers.read_texts(spark, str(tmp_path / "u")).first().text == "one\ntwo"
