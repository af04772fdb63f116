"""Small fixed tables: salience, scoring profiles, quotas, prices and labels."""

from __future__ import annotations

# Salience.
WEIGHTS = {"rule": 0.60, "tfidf": 0.22, "density": 0.10, "length": 0.08}
UNKNOWN_WORD, FULL_LENGTH, FLOOR, CEILING, TOP_TERMS = 0.15, 20.0, 0.05, 0.95, 100
STOPWORDS = ["的", "了", "在", "是", "也", "就", "不", "有", "和", "与", "及", "对", "为", "这", "那", "上", "中"]

# Scoring profiles (cap, innovation rate, depth rate, data caps, strict numbers).
PROFILES = {
    "teacher": {"cap": 85, "rate": 0.55, "depth": 0.20, "expr": 12, "conc": 8, "cross": 5, "strict": False},
    "expert": {"cap": 72, "rate": 0.46, "depth": 0.17, "expr": 10, "conc": 7, "cross": 5, "strict": False},
    "professor": {"cap": 65, "rate": 0.38, "depth": 0.14, "expr": 7, "conc": 6, "cross": 4, "strict": True},
}
STRUCTURE_POINTS = {"abstract": 8, "keywords": 4, "method": 6, "experiment": 4, "conclusion": 3}
NUMBER_STRICT = r"\d+\.?\d*\s*(?:%|ms|μs|ns|dB|dBm|bps|Mbps|Gbps|Hz|kHz|MHz|GHz|GB|MB|KB|fps|W|mW|x|×|倍|个百分点)|\d+\.\d+"
NUMBER = NUMBER_STRICT + r"|\b\d{2,}\b"

# Keywords that make a sentence a fallback candidate.
DENSITY_WORDS = ["提出", "研究", "方法", "实验", "结论", "模型", "算法", "分析", "设计", "验证", "结果", "性能"]
DENSITY_WORDS += ["propose", "method", "experiment", "result", "conclusion", "model", "algorithm", "analysis", "approach", "performance"]
DENSITY_WORDS += ["contribution", "novel", "framework"]

# Marks of page furniture, for files known to carry watermarks.
WATERMARKS = ["下载", "download", "预印本", "preprint", "版权所有", "copyright", "http", "doi:", "知网", "cnki", "chinaxiv", "arxiv.org"]

# Quotas, windows in seconds and prices in USD a million tokens (in, out).
VISITOR_CAP, IP_CAP, GLOBAL_CAP, DAY = 5, 20, 2000, 86400
PREMIUM_CAP, PREMIUM_WINDOW = 5, 18000
PRICES = {"flash": (0.14, 0.28), "v4pro": (1.74, 3.48)}
USD_CNY = 7.1

# Colloquial words and what polishing puts in their place, in order.
POLISH = {
    "很快": ["低延迟", "高吞吐量", "时间复杂度优化"],
    "省空间": ["内存优化", "空间复杂度低", "轻量级"],
    "很好用": ["高可用性", "用户友好"],
    "很稳定": ["高鲁棒性", "容错率高"],
    "算得很准": ["高精度", "召回率高"],
    "用": ["采用", "利用", "部署"],
    "做": ["实现", "构建", "提出"],
    "看": ["分析", "评估", "观测"],
    "找": ["检索", "遍历", "挖掘"],
    "因为": ["鉴于", "归因于"],
    "所以": ["因此", "进而"],
    "然后": ["随后", "进一步地"],
    "我们觉得": ["实验表明", "数据显示"],
    "我证明了": ["本文验证了", "结果证实了"],
}
SUMMARY_STOPWORDS = ["的", "了", "在", "是", "我", "也", "就", "不", "人", "有"]

# Sections, positive and negative rules of weak labels.
SECTION_OF = {"problem_motivation": "引言", "conclusion_extract": "结论", "limitation_future": "结论"}
SECTION_OF |= dict.fromkeys(
    "definition_notation method_extract system_architecture algorithm_extract innovation_extract implementation formula_extract theorem_proof".split(), "方法"
)
SECTION_OF |= dict.fromkeys(
    "hyperparameter_setting experiment_setup experiment_result performance_gain metric_indicator figure_table_ref statistical_significance comparison_baseline".split(),
    "实验",
)
POSITIVE = ["method_extract", "system_architecture", "algorithm_extract", "innovation_extract"]
NEGATIVE = "experiment_setup experiment_result performance_gain metric_indicator figure_table_ref comparison_baseline".split()
NEGATIVE += ["problem_motivation", "definition_notation", "theorem_proof", "formula_extract"]

# Keys of a model's answer and the names they stand for, exact or contained.
ANSWER_KEYS = {
    "研究问题": "research_question",
    "核心方法": "core_method",
    "关键公式": "key_formulas",
    "公式": "key_formulas",
    "公式描述": "key_formulas",
    "实验数据": "experimental_data",
    "关键实验数据": "experimental_data",
    "实验结果": "experimental_data",
    "结论": "conclusion",
    "主要结论": "conclusion",
    "创新点": "innovations",
    "创新贡献": "innovations",
    "潜在风险": "potential_risks",
    "潜在局限": "potential_risks",
    "局限": "potential_risks",
    "风险": "potential_risks",
    "改进建议": "improvement_suggestions",
    "建议修改方向": "improvement_suggestions",
    "修改建议": "improvement_suggestions",
    "研究背景": "background",
    "背景": "background",
    "实验亮点": "highlights",
    "亮点": "highlights",
    "变量": "variables",
    "实验设置": "experiment_setup",
    "关键结果": "key_results",
}
