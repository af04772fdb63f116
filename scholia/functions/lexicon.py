"""Keyword lists for scoring.

A full lexicon is a parameter: ``load`` reads one from a JSON file with keys ``innovation`` and
``method`` ({mode: [keywords]}) and ``rubrics`` ({subject: {category: [keywords]}}).  The lists here
are a small default of our own in English, Chinese, Japanese, Korean and German.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import SparkSession

INNOVATION = {
    "teacher": ["propose", "novel", "first time", "new method", "contribution", "improve", "提出", "创新", "首次", "新方法", "改进", "提案", "新しい", "제안", "새로운", "neuartig", "vorgeschlagen"],
    "expert": ["propose", "novel", "first time", "contribution", "提出", "创新", "首次", "提案", "제안", "neuartig"],
    "professor": ["novel", "first time", "首次", "创新", "新規", "최초", "neuartig"],
}
METHOD = {
    "teacher": ["model", "framework", "algorithm", "loss function", "dataset", "training", "evaluation", "simulation", "learning rate", "accuracy", "模型", "算法", "框架", "训练", "手法", "モデル", "방법", "모델", "verfahren", "modell"],
    "expert": ["framework", "algorithm", "loss function", "learning rate", "ablation", "算法", "损失函数", "アルゴリズム", "알고리즘", "algorithmus"],
    "professor": ["loss function", "convergence", "ablation", "complexity", "收敛", "复杂度", "収束", "수렴", "konvergenz"],
}
RUBRICS = {
    "cs": {"model": ["model", "framework", "模型"], "training": ["learning rate", "loss function", "训练"], "data": ["dataset", "数据集"], "evaluation": ["accuracy", "baseline", "准确率"]},
    "medical": {"design": ["cohort", "trial", "队列"], "inference": ["p-value", "confidence interval", "置信区间"], "outcome": ["mortality", "outcome", "结局"], "sample": ["patients", "inclusion", "患者"]},
    "engineering": {"modelling": ["simulation", "model", "仿真"], "measurement": ["sensor", "measure", "测量"], "performance": ["latency", "power", "功耗"], "control": ["control", "system", "控制"]},
    "materials": {"synthesis": ["sintering", "anneal", "制备"], "characterisation": ["xrd", "microscopy", "表征"], "testing": ["tensile", "hardness", "硬度"], "mechanism": ["grain", "phase", "晶粒"]},
    "theory": {"definitions": ["assume", "definition", "定义"], "theorems": ["theorem", "lemma", "定理"], "bounds": ["upper bound", "complexity", "上界"], "convergence": ["converge", "existence", "收敛"]},
    "electronics": {"circuits": ["circuit", "amplifier", "电路"], "signals": ["filter", "spectrum", "信号"], "communication": ["channel", "modulation", "信道"], "power": ["voltage", "inverter", "电压"]},
    "civil": {"structures": ["beam", "stiffness", "结构"], "materials": ["concrete", "steel", "混凝土"], "dynamics": ["seismic", "vibration", "抗震"], "ground": ["soil", "foundation", "地基"]},
    "biology": {"techniques": ["pcr", "sequencing", "测序"], "cells": ["cell", "protein", "细胞"], "phenotypes": ["phenotype", "expression", "表型"], "mechanism": ["pathway", "mouse", "通路"]},
    "social": {"design": ["survey", "interview", "问卷"], "collection": ["respondents", "questionnaire", "受访者"], "analysis": ["coding", "content analysis", "编码"], "statistics": ["regression", "correlation", "回归"]},
    "general": {"process": ["method", "approach", "方法"], "statistics": ["statistical", "significance", "统计"], "data": ["data", "sample", "数据"], "evaluation": ["results", "evaluation", "结果"]},
}


def load(path: str | None = None, spark: SparkSession | None = None) -> dict:
    """The lexicon of a JSON file that Spark can read, or the default."""
    if path is None:
        return {"innovation": INNOVATION, "method": METHOD, "rubrics": RUBRICS}
    found = _read(path, spark or SparkSession.active())
    return {"innovation": found.get("innovation", INNOVATION), "method": found.get("method", METHOD), "rubrics": found.get("rubrics", RUBRICS)}


@cache
def _read(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def distinct(words: list[str]) -> list[str]:
    """Lower-cased keywords without repeats, in order."""
    return list(dict.fromkeys(w.lower() for w in words))
