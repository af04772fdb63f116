"""Sections of a paper in five languages, by headings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import strip

# Heading patterns of each section in the order in which they are tried (any: followed
# by a line end or colon; line: by a line end; dash: by a dash; mark: below a # heading), headings that
# end it, and the most characters kept.
NUMBER = r"(?:(?:[\d一二三四五六七八九十]+|[IVXLC]{1,6})\s*[\.、\s]?\s*)?"
HEADINGS = {
    "abstract": [
        ("any", r"摘\s*要"),
        ("any", r"(?:要\s*旨|概\s*要|抄\s*録|アブストラクト)"),
        ("any", r"(?:초\s*록|요\s*약|개\s*요)"),
        ("any", r"(?:Zusammenfassung|Kurzfassung|Abstrakt)"),
        ("line", r"Abstract"),
        ("dash", r"Abstract"),
        ("any", r"(?:项目概述|研究背景|背景与意义)"),
        ("mark", r"(?:Abstract|摘要|要旨)"),
    ],
    "method": [
        ("any", r"(?:研究方法|本文方法|所提方法|资料与方法|材料与方法|对象与方法|方\s*法)"),
        ("any", r"(?:实验\s*方法|试验\s*方法|实验部分|实验设计|实验过程|实验步骤|实验材料|样品制备|材料制备|制备\s*(?:工艺|方法|与表征))"),
        ("any", r"(?:提案手法|提案法|提案する手法|手\s*法|システム構成|問題設定|準備)"),
        ("any", r"(?:제안\s*(?:방법|기법)|연구\s*방법|방\s*법|접근법|시스템\s*구성|문제\s*정의)"),
        ("any", r"(?:Methodik|Methoden|Methode|Vorgeschlagene\s+\w+|Ansatz|Systemmodell|Problemstellung|Vorgehensweise)"),
        ("line", r"(?:Method(?:ology)?|Approach|Algorithm)"),
        ("any", r"(?:Materials?\s+and\s+Methods?|Experimental\s+(?:Section|Details|Setup|Procedures?|Methods?|Methodology|Techniques?)|Sample\s+Preparation|Synthesis(?:\s+and\s+Characterization)?)"),
        ("line", r"(?:(?:System|Signal|Channel|Network)\s+(?:Model|Architecture)|Problem\s+(?:Formulation|Statement|Definition)|Proposed\s+[A-Za-z][\w\- ]{0,40}|Preliminaries|Design\s+of\s+\w+)"),
        ("any", r"(?:技术方案|系统设计|实现方案|系统模型|问题建模|算法设计)"),
        ("mark", r"(?:\d+\.?\s*)?(?:Method|Research Method|研究方法)"),
    ],
    "experiment": [
        ("any", r"(?:实\s*验(?:结果|与分析)?|仿\s*真(?:实验)?|结\s*果(?:与分析|与讨论)?)"),
        ("any", r"(?:実\s*験(?:結果)?|評\s*価(?:実験)?|結\s*果(?:と考察)?)"),
        ("any", r"(?:실\s*험(?:\s*결과)?|평\s*가|결\s*과(?:\s*및\s*분석)?)"),
        ("any", r"(?:Experimente|Experiment|Evaluierung|Auswertung|Ergebnisse)"),
        ("line", r"(?:Experiment(?:al\s*Results?)?|Simulation(?:\s*Results?)?|Results?)"),
        ("any", r"(?:测试结果|验证实验|效果评估)"),
        ("mark", r"(?:\d+\.?\s*)?(?:Experiment|Results|实验结果|実験)"),
    ],
    "conclusion": [
        ("any", r"(?:结\s*论|结\s*语|结\s*束\s*语|总\s*结|小\s*结)"),
        ("any", r"(?:結\s*論|結\s*言|おわりに|まとめ|結びに)"),
        ("any", r"(?:결\s*론|맺음말|요약\s*및\s*결론)"),
        ("any", r"(?:Fazit|Schlussfolgerung(?:en)?|Schluss|Zusammenfassung\s+und\s+Ausblick)"),
        ("line", r"(?:Conclusion|CONCLUSION|Summary)"),
        ("any", r"(?:总结与展望|项目总结|预期成果)"),
        ("mark", r"(?:\d+\.?\s*)?(?:Conclusion|结论|結論)"),
    ],
}
STOPS = {
    "abstract": r"关键词|Keywords?|Index\s*Terms?|引言|Introduction|キーワード|はじめに|序論|키워드|서\s*론|Schl(?:ü|ue)sselw(?:ö|oe)rter|Stichw(?:ö|oe)rter|Einleitung|\d+\s*[\.、]|一、",
    "method": r"实验|仿真|结论|总结|Experiment|Result|Conclusion|実験|評価|結論|おわりに|실\s*험|평\s*가|결\s*과|결\s*론|Ergebnisse|Evaluierung|Auswertung|Fazit|Schlussfolgerung|\d+\s*[\.、]",
    "experiment": r"结论|总结|讨论|Conclusion|Discussion|結論|おわりに|まとめ|결\s*론|맺음말|Fazit|Schlussfolgerung|\d+\s*[\.、]",
    "conclusion": r"参考文献|致\s*谢|References?|Acknowledg|謝\s*辞|참고\s*문헌|감사의\s*글|Literatur(?:verzeichnis)?|Danksagung",
}
LIMITS = {"abstract": 600, "method": 500, "experiment": 500, "conclusion": 600}
KEYWORDS = r"(?:关键词|关键字|Keywords?|Index\s*Terms?|キーワード|키워드|주제어|색인어|Schl(?:ü|ue)sselw(?:ö|oe)rter|Stichw(?:ö|oe)rter|Schlagw(?:ö|oe)rter)\s*[：:—–\-]\s*([^\n]{5,300})"
#: For each heading, in the same order, what its hits hold without case, one of them at least: a look for these costs far less than the pattern.
#: Of letters with blanks between them it is one.
HOLDS = {
    "abstract": ["摘", "旨|概|抄|アブストラクト", "초|요|개", "zusammenfassung|kurzfassung|abstrakt", "abstract", "abstract", "项目概述|研究背景|背景与意义", "#"],
    "method": [
        "方",
        "实|试|样品制备|材料制备|制备",
        "提案|手|システム構成|問題設定|準備",
        "제안|연구|방|접근법|시스템|문제",
        "methodik|methode|vorgeschlagene|ansatz|systemmodell|problemstellung|vorgehensweise",
        "method|approach|algorithm",
        "material|experimental|sample|synthesis",
        "system|signal|channel|network|problem|proposed|preliminaries|design",
        "技术方案|系统设计|实现方案|系统模型|问题建模|算法设计",
        "#",
    ],
    "experiment": ["实|仿|结", "実|評|結", "실|평|결", "experiment|evaluierung|auswertung|ergebnisse", "experiment|simulation|result", "测试结果|验证实验|效果评估", "#"],
    "conclusion": ["结|总|小", "結|おわりに|まとめ", "결|맺음말|요약", "fazit|schluss|zusammenfassung", "conclusion|summary", "总结与展望|项目总结|预期成果", "#"],
    "keywords": ["关键|keyword|index|キーワード|키워드|주제어|색인어|schl|stichw"],
}
BODY = r"([\s\S]{30,})"
NAMES = ["abstract", "keywords", "method", "experiment", "conclusion"]


def heading(kind: str, words: str) -> str:
    """Pattern whose group 1 is everything below a heading."""
    if kind == "mark":
        return rf"(?:^|\n)#{{1,3}}\s*{words}[^\n]*\n{BODY}"
    after = {"any": r"[ \t]*[\n：:]", "line": r"[ \t]*\n", "dash": r"\s*[—–\-][ \t]*"}[kind]
    return rf"(?:^|\n)[ \t]*{NUMBER}{words}{after}{BODY}"


def folded(text: Column) -> Column:
    """A text in which letters that match i and s without case are these (the engine's lower case leaves some, and parts the dotted I)."""
    return F.translate(F.lower(text), "ıſ\u0307", "is")


def section(text: Column, low: Column, name: str) -> Column:
    """One section, or null: the first pattern that matches decides, even if nothing remains of its body.  ``low``: the text ``folded``."""
    may = [reduce(or_, (F.contains(low, F.lit(w)) for w in held.split("|"))) for held in HOLDS[name]]
    if name == "keywords":
        found = F.when(may[0], strip(F.regexp_extract(text, "(?iUd)" + KEYWORDS, 1)))
        return F.when(found != "", found)
    # Each body has 30 characters at least, so '' means that a pattern did not match.
    bodies = [F.when(m, F.nullif(F.regexp_extract(text, "(?iUdm)" + heading(*h), 1), F.lit(""))) for m, h in zip(may, HEADINGS[name], strict=True)]
    cut = F.regexp_replace(strip(F.coalesce(*bodies)), rf"(?Uds)\n[ \t]*(?:{STOPS[name]}).*", "")
    kept = F.substring(strip(cut), 1, LIMITS[name])
    return F.when(kept != "", kept)


def _with_folded(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_low``; a generator keeps it from being made again for each look."""
    return docs.withColumn("_low", F.explode(F.array(folded(F.col("text")))))


def extract_sections(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and a column per section (null where there is none)."""
    return _with_folded(docs.select(id_col, "text")).select(id_col, *[section(F.col("text"), F.col("_low"), n).alias(n) for n in NAMES])


def with_sections(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` with the sections and ``more``, made from these; a generator keeps each from being computed again by each use."""
    found = F.struct(*[section(F.col("text"), F.col("_low"), n).alias(n) for n in NAMES])
    rows = _with_folded(docs).withColumn("_s", F.explode(F.array(found))).select(*docs.columns, "_s.*")
    if not more:
        return rows
    return rows.withColumn("_m", F.explode(F.array(F.struct(*[c.alias(n) for n, c in more.items()])))).select(*rows.columns, "_m.*")
