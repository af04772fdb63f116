"""Text of uploaded files: the first extractor whose output passes the quality gate."""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import fields, map_rows
from ..operators.clean import GARBLED_SHARE, GARBLED_WEIGHT, GOOD_ASCII, GOOD_CJK, GOOD_SHARE, reflow, strip_repeated
from .papers import extension

Extractor = Callable[[bytes], str]
_GOOD = re.compile(f"[{GOOD_ASCII}一-鿿{GOOD_CJK}]")


def passes_gate(text: str | None) -> bool:
    """``operators.clean.quality_ok`` for one string, inside an extractor's task."""
    if not text or not text.strip():
        return False
    marks = text.count("(cid:")
    if marks and marks * GARBLED_WEIGHT > len(text) * GARBLED_SHARE:
        return False
    bare = "".join(text.split())
    return len(_GOOD.findall(bare)) >= GOOD_SHARE * len(bare)


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def _pdfplumber(content: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return reflow("\n".join(page.extract_text() or "" for page in pdf.pages)) or ""


def _pypdf(content: bytes) -> str:
    from PyPDF2 import PdfReader

    return reflow("\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)) or ""


def extractors() -> dict[str, list[tuple[str, Extractor]]]:
    """Extractors by extension, in order; PDF readers only where they are installed."""
    pdf = [(name, f) for name, f in (("pdfplumber", _pdfplumber), ("PyPDF2", _pypdf)) if importlib.util.find_spec(name)]
    return {"pdf": pdf, "docx": [("docx", docx_text)]}


def text_of(kind: str, content: bytes | None, aggressive: bool = False, chain: dict[str, list[tuple[str, Extractor]]] | None = None) -> tuple[str, str]:
    """(text, extractor) of one file; ('', '') if nothing passes.

    Plain text and Markdown are taken as they are if not blank.  A file that an extractor can't read
    goes to the next one.
    """
    if content is None:
        return "", ""
    if kind in ("txt", "md"):
        text = content.decode("utf-8", "ignore")
        return (text, "plain") if text.strip() else ("", "")
    for name, extract in (chain if chain is not None else extractors()).get(kind, []):
        try:
            text = strip_repeated(extract(content), aggressive) or ""
        except Exception as error:  # broken files are data here: the chain goes on, and says why
            print(f"{name}: {error}")
            continue
        if passes_gate(text):
            return text, name
    return "", ""


def extract_files(files: DataFrame, aggressive: bool = False, chain: dict[str, list[tuple[str, Extractor]]] | None = None) -> DataFrame:
    """(path, text, extractor) of the files that ``read_binaries`` gives; other extensions give ''."""
    rows = files.withColumn("_kind", extension(F.col("path")))
    return map_rows(rows, ["path"], ["_kind", "content"], fields("text:string extractor:string"), lambda kind, content: [text_of(kind, content, aggressive, chain)])
