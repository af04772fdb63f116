"""The table of content rules."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    action: str
    prior: float
    description: str
    pattern: str


# Names, actions, priors, descriptions and patterns, in the order in which rules apply.
RULES = [
    Rule("problem_motivation", "keep", 0.8, "研究问题 / 动机 / 目标", r"(针对[^\n，。；]{0,20}?(问题|挑战|不足|局限|难题|现象)|为(了)?(解决|应对|克服|缓解)|旨在|本文(主要)?(研究|关注)|研究目标|存在[^\n，。；]{0,15}?(问题|不足|缺陷)|难以[^\n，。；]{0,12}?(满足|实现)|to address|to solve|to tackle|aim(s|ed)? (to|at)|the problem of|motivated by|in order to|to overcome|to deal with|suffer(s|ed)? from)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("definition_notation", "keep", 0.72, "定义 / 符号约定", r"(定义为|记为|表示为|令[^\n，。；]{0,8}?[为表]|设[^\n，。；]{0,8}?为|其中[^\n，。；]{0,12}?表示|定义[^\n，。；]{0,8}?如下|denote(s|d)?(\s+by)?|is defined as|we define|where[^\n，。；]{0,15}?denotes?)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("method_extract", "keep", 0.78, "方法 / 技术路线", r"(本文方法|所提方法|提出了?|设计了?|构建了?|建立了?|采用了?|引入了?|利用[^\n，。；]{0,12}?(方法|模型|机制|策略)|基于[^\n，。；]{0,20}?(方法|模型|框架|算法|网络|策略|机制)|通过[^\n，。；]{0,20}?(实现|完成|得到)|the proposed method|our (method|approach|scheme)|we (design|develop|build|introduce|adopt|employ|utilize|propose)|is proposed|method(s)? based on|based on[^\n，。；]{0,20}?(method|model|framework|network))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("system_architecture", "keep", 0.75, "系统架构 / 框架 / 模块组成", r"(系统(架构|结构|框架)|整体(架构|框架|流程|结构)|总体设计|网络结构|由[^\n，。；]{0,30}?(组成|构成)|包含[^\n，。；]{0,30}?(模块|部分|单元|层)|分为[^\n，。；]{0,20}?(模块|部分|阶段)|the (overall|proposed|whole) (architecture|framework|system|pipeline|network)|consists? of|is composed of|the framework (of|consists)|our (system|framework|pipeline)|the architecture of)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("algorithm_extract", "keep", 0.78, "算法 / 流程 / 优化目标", r"(算法[\s\d]|算法(流程|步骤|描述)|伪代码|时间复杂度|空间复杂度|计算复杂度|迭代(过程|更新|求解)|优化(目标|问题|算法)|损失函数|目标函数|梯度(下降|更新)|收敛性?|Algorithm\s*\d|the algorithm|time complexity|space complexity|loss function|objective function|optimization (problem|objective)|we optimize|gradient descent|converge(s|nce)?)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("innovation_extract", "keep", 0.82, "创新点 / 主要贡献", r"(主要贡献|核心创新|创新点|本文工作|我们提出|主要工作|首次(提出|实现|引入)|与[^\n，。；]{0,15}?不同|不同于[^\n，。；]{0,20}?(现有|已有|传统)|区别于|main contribution|key contribution|our contribution|the contributions of|key innovation|we propose a novel|novel(ty)?|for the first time|unlike (existing|previous|prior|conventional))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("experiment_setup", "keep", 0.78, "实验设置 / 数据集 / 评价指标", r"(实验(设置|环境|配置|平台|条件|参数)|数据集|训练集|测试集|验证集|样本(数|量|集)|消融(实验|研究)|对比实验|评价指标|评估指标|基准(方法|模型)|in (our|the) experiments?|the dataset|training set|test(ing)? set|validation set|evaluation metric|ablation (study|experiment)|experimental setup|we (conduct|perform|carry out)[^\n，。；]{0,20}?experiment|benchmark|baseline(s)?)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("experiment_result", "keep", 0.82, "实验结果 / 评测数据", r"(实验结果(表明|显示|证明|说明)|结果(表明|显示|证明|说明)|实验表明|测试结果|准确率|精确率|精度|召回率|查准率|查全率|均方误差|误差率?|结果显示|experimental results (show|demonstrate|indicate|reveal)|results (show|demonstrate|indicate|reveal)|achieve(s|d)?|accuracy|precision|recall|F1[\s-]?score|RMSE|the results)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("performance_gain", "keep", 0.85, "性能对比 / 数值提升（强信号）", r"((提升|提高|增加|改善|降低|减少|缩短|节省)了?\s*\d+(\.\d+)?\s*(%|个百分点|倍|dB)|相比[^\n，。；]{0,25}?(提升|提高|优于|超过|降低)|优于|超过[^\n，。；]{0,10}?(现有|基线|对比)|领先|达到[^\n，。；]{0,15}?(最优|最高|state)|(improve|increase|reduce|decrease|boost|gain)(s|d|es)?\s+(by\s+)?\d+(\.\d+)?\s*%|outperform(s|ed)?|surpass(es|ed)?|superior to|state-of-the-art|SOTA|the best (performance|result|accuracy))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("metric_indicator", "keep", 0.74, "性能指标 / 工科度量", r"(吞吐量|吞吐率|延迟|时延|能耗|功耗|信噪比|误码率|帧率|带宽|响应时间|资源利用率|内存占用|运行时间|throughput|latency|energy consumption|power consumption|signal[- ]to[- ]noise|bit error rate|frame rate|bandwidth|response time|memory (usage|footprint)|runtime)[^\n。！？；]{0,18}?\d[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("figure_table_ref", "keep", 0.73, "图表引用（指向关键数据）", r"(如(图|表)\s*\d|(图|表)\s*\d[^\n，。；]{0,4}?(所示|显示|表明|给出|列出)|见(图|表)\s*\d|(Fig(ure)?|Table)\.?\s*\d[^\n，。；]{0,4}?(shows?|illustrates?|presents?|depicts?|reports?|lists?|summarizes?))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("formula_extract", "keep", 0.88, "公式（LaTeX / 编号引用）", r"\$[^$\n]*[\\^_=][^$\n]*\$|\\begin\{equation\}.*?\\end\{equation\}|\\begin\{align\}.*?\\end\{align\}|公式\s*\(?\d+\)?|式\s*\(\d+\)|Eq(uation)?\.?\s*\(?\d+\)?"),
    Rule("theorem_proof", "keep", 0.8, "定理 / 引理 / 证明 / 假设", r"(定理\s*\d|引理\s*\d|推论\s*\d|命题\s*\d|证明[:：]|假设[\s\d]|前提条件|约束条件|满足[^\n，。；]{0,15}?条件|Theorem\s*\d|Lemma\s*\d|Corollary\s*\d|Proposition\s*\d|we (prove|assume)|assume(s|d)? that|subject to|the proof of|it follows that)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("implementation", "keep", 0.7, "实现 / 运行环境", r"(基于[^\n，。；]{0,15}?(平台|框架)实现|在[^\n，。；]{0,15}?(平台|环境|GPU|CPU|FPGA|服务器|集群)上(实现|运行|部署|训练|测试)|使用[^\n，。；]{0,12}?(框架|工具|库)实现|代码(基于|使用)|implemented (in|on|using|with)|is implemented|we implement|run(s)? on[^\n，。；]{0,15}?(GPU|CPU|FPGA|platform|server|cluster)|using (PyTorch|TensorFlow|Keras|CUDA))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("conclusion_extract", "keep", 0.8, "结论性语句", r"(结论|综上所述|综上|总的来说|本文(提出|设计|采用|实现|研究|构建)|本研究|研究表明|可以得出|得出结论|实验(充分)?证明|in conclusion|to conclude|we conclude|in summary|to summarize|this paper (proposes|presents|introduces|develops)|overall,|our (work|study) (shows|demonstrates))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("limitation_future", "keep", 0.7, "局限 / 未来工作", r"(局限性?|不足之处|有待(改进|提高|完善)|未来(工作|研究|方向)|进一步(研究|工作|改进|探索)|下一步(工作)?|尚(存在|需|未)|仍然?(存在|面临)|limitation(s)?|future work|in (the )?future|further (research|work|study|investigation)|remains? to be|leave[^\n，。；]{0,15}?future work)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("generic_background", "review", 0.45, "通用背景铺垫", r"(随着[^\n。！？]{0,30}?的(发展|进步|普及|提高)|近年来|当今(社会|时代)|众所周知|如今|长期以来|在[^\n。！？]{0,15}?背景下|in recent years|with the (development|growth|advancement|progress)|recently,|it is well known|nowadays|over the past)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("importance_cliche", "review", 0.4, "重要性 / 广泛应用套话", r"(具有(重要|重大)[^\n。！？]{0,10}?(意义|价值|作用)|得到了?广泛(的)?(应用|关注|研究)|受到[^\n。！？]{0,10}?(广泛)?关注|发挥[^\n。！？]{0,8}?重要作用|扮演[^\n。！？]{0,8}?重要角色|至关重要|不可或缺|越来越[^\n。！？]{0,8}?(重要|受到)|play(s|ed)? an? (important|crucial|key|vital|significant) role|is of great (importance|significance)|has attracted[^\n。！？]{0,15}?attention|widely (used|applied|adopted|studied)|an important role)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("common_definition", "review", 0.4, "常识性泛定义", r"(所谓[^\n。！？]{0,10}?(是指|指的是|就是)|通常(是指|指的是)|一般(是指|指的是)|可以(理解为|看作是?)|是指[^\n。！？]{0,4}?一(种|类)|refer(s|red)? to as|is a (kind|type) of|commonly (known|referred to) as)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("redundant_transition", "review", 0.4, "冗余过渡 / 章节预告", r"(首先|其次|再次|然后|最后|总而言之|一方面|另一方面|本文(的)?(组织|结构)(如下|安排)|本文(余下|剩余|其余)部分|本章(主要)?(介绍|讨论|阐述)|firstly|secondly|thirdly|finally,|on the one hand|on the other hand|the (rest|remainder) of this paper|is organized as follows|the structure of this paper|the remainder)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("filler_hedge", "review", 0.38, "填充词 / 模糊限定", r"(值得(注意|一提|指出)的是|需要(注意|指出|说明)的是|不难(发现|看出|得到)|显而易见|在一定程度上|某种程度上|相对而言|总体而言|一般来说|it (is|should be) (worth )?(noting|noted|mentioned|pointed out|emphasized)|it is worth (noting|mentioning)|it (can|could|may) be (seen|observed|shown|noted|verified|found|concluded)|we (can|could) (see|observe|note|find|conclude)|note that|notice that|as (mentioned|shown|discussed|noted|described|illustrated|seen) (above|earlier|previously)|to some extent|generally speaking|in general,)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("vague_prospect", "review", 0.38, "空泛展望", r"(提供了?[^\n。！？]{0,8}?新(思路|视角|途径|方向)|具有[^\n。！？]{0,8}?(广阔|广泛|巨大)[^\n。！？]{0,6}?(前景|潜力|价值)|应用前景[^\n。！？]{0,8}?(广|好)|有望[^\n。！？]{0,12}?|为[^\n。！？]{0,12}?提供[^\n。！？]{0,8}?(参考|借鉴|思路)|provides? a (new|novel|promising)|has (great|wide|broad) (potential|prospects?)|is promising|paves? the way|opens? (up )?new)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("acknowledgment_funding", "review", 0.35, "致谢 / 基金资助", r"(致\s*谢|衷心感谢|感谢[^\n。！？]{0,20}?(老师|导师|同学|审稿|课题组|基金|资助|支持)|本(文|研究|工作)(得到|受到?)[^\n。！？]{0,20}?(基金|项目|课题|资助)|国家自然科学基金|课题(资助|支持)|acknowledg(e?ment|ements)|we (would like to )?thank|this work (was|is) (partially )?supported (by|in part)|funded by|grant (no|number|#))[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("statistical_significance", "keep", 0.82, "统计显著性 / 检验", r"(统计(学)?(上)?显著|显著性(差异|检验|水平)|显著差异|p\s*[<>=]\s*0?\.\d+|置信区间|置信水平|方差分析|[tF]\s*检验|卡方检验|假设检验|standard (deviation|error)|p-?values?|confidence intervals?|statistical(ly)? significan|t-tests?|ANOVA|chi-square|hypothesis test)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("hyperparameter_setting", "keep", 0.74, "超参数 / 训练设置", r"(学习率|批(大小|尺寸|量大小)|批量大小|迭代(次数|轮数)|训练轮数|轮次为|隐藏层|权重衰减|正则化系数|学习速率|优化器|参数初始化|learning rate|batch\s*size|epochs?|hidden (layer|unit)s?|dropout|weight decay|optimi[sz]er|\bAdam\b|\bSGD\b|hyper-?parameter|fine-?tun(e|ing|ed))[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("comparison_baseline", "keep", 0.75, "对比 / 基线方法", r"(与[^\n，。；]{0,15}?(方法|算法|模型|基线|工作|方案)[^\n，。；]{0,6}?(相比|对比|比较)|相比(之下|于)[^\n，。；]{0,10}?(方法|基线|现有|传统)|对比[^\n，。；]{0,8}?(方法|算法|实验|基线)|优于[^\n，。；]{0,10}?(基线|现有方法|传统方法)|compared (to|with)|in comparison (to|with)|(outperform|surpass|exceed|beat)(s|ed)?[^\n，。；]{0,12}?(baseline|existing|prior|state-of)|than (the |existing |prior )?baselines?|over (the |existing )?baselines?)[^\n；。！？]{0,}[；。！？\n]?"),
    Rule("exaggeration", "review", 0.38, "绝对化 / 夸大", r"(大大(地)?(提高|提升|改善|降低|增强|减少|缩短)|极大(地|程度上)|完美(地)?(解决|实现|契合)|彻底(地)?(解决|改变|消除)|前所未有|无可比拟|遥遥领先|完全(超越|优于|解决)|极其(重要|优异|出色)|greatly|dramatically|remarkably|perfectly (solve|address)|completely (solve|outperform)|far (superior|better)|unprecedented)[^\n。！？]{0,}?(。|！|？|\n)"),
    Rule("tautology_verbose", "review", 0.36, "同义反复 / 啰嗦", r"(换言之|换句话说|也就是说|亦即|换个角度(说|看)|从某种(意义|程度)上(说|讲)?|严格(来说|地说)|准确地?说|in other words|that is to say|to put it (differently|another way)|strictly speaking|more precisely,)[^\n。！？]{0,}?(。|！|？|\n)"),
]

# What each rule's hits tell a reader.
NOTES = {
    "problem_motivation": "点明论文要解决的问题，是全文的出发点，删了就看不懂为什么做。",
    "definition_notation": "形式化定义或符号约定，是读懂后文公式与方法的前提。",
    "method_extract": "核心方法 / 技术路线所在，论文最该保留的部分之一。",
    "system_architecture": "系统或模型的整体结构，理解全文的骨架。",
    "algorithm_extract": "算法流程或优化目标，方法可复现的关键细节。",
    "innovation_extract": "作者自述的创新与贡献，答辩、审稿最关注的地方。",
    "experiment_setup": "实验怎么做的（数据集 / 指标 / 设置），决定结果可不可信。",
    "experiment_result": "实验得到的关键结果与数据，论文的事实依据。",
    "performance_gain": "量化的性能提升 / 对比优势，最硬的证据，务必保留。",
    "metric_indicator": "吞吐、延迟、能耗等工科度量的实测值（须带数字，光提指标名不计入）。",
    "figure_table_ref": "指向图 / 表的句子，通常承载关键数据或结论，是结果的索引。",
    "formula_extract": "公式 / 数学表达，方法的形式化核心。",
    "theorem_proof": "理论结果（定理 / 证明 / 假设），论文的理论支撑。",
    "implementation": "实现与运行环境（平台 / 硬件 / 框架），关乎可复现性。",
    "conclusion_extract": "结论性论断，全文要点的收口。",
    "limitation_future": "作者承认的局限与后续方向，体现研究的严谨与边界。",
    "generic_background": "开头的背景铺垫，与核心结论关系弱。这类「近年来 / 随着…发展」的套话通常可删，或压成一句。",
    "importance_cliche": "「具有重要意义 / 广泛应用」是泛化论断、缺具体支撑，审稿常视为注水。建议删，或换成具体数据。",
    "common_definition": "对常识概念的泛泛解释（「所谓…是指」「通常指…」），多为铺垫，对核心贡献无增量，可删。",
    "redundant_transition": "纯过渡或章节预告（「首先 / 其次」「本文组织如下」），信息量低，精简后不影响阅读。",
    "filler_hedge": "「值得注意的是 / 在一定程度上」等填充与模糊限定词，删掉不损信息，句子更紧。",
    "vague_prospect": "「提供了新思路 / 应用前景广阔 / 有望」类空泛展望，缺落地依据，建议删或换成具体方向。",
    "acknowledgment_funding": "致谢 / 基金属正文外信息，提取论文核心内容时一般可剔除。",
    "statistical_significance": "统计显著性（p 值 / 置信区间 / 显著性检验），结果可信度的硬证据。",
    "hyperparameter_setting": "学习率、batch、轮数等超参与训练设置，决定结果能否复现。",
    "comparison_baseline": "与基线 / 现有方法的对比，是衡量贡献大小的参照系。",
    "exaggeration": "「大大 / 极大 / 完美 / 前所未有」类无数据支撑的夸大，审稿易反感，建议删或换成具体数字。",
    "tautology_verbose": "「换言之 / 也就是说 / 亦即」等重复表述，前句已说清，删之更紧凑。",
}

# What a rule's hits begin with, from its pattern: characters that anything may follow, ASCII characters and what follows
# them, other characters.
BEGINS = {
    "problem_motivation": ("", "AIMSTaimst", "HINOUhinou", "为存旨本研针难"),
    "definition_notation": ("", "DIWdiw", "EHSehs", "令其定表记设"),
    "method_extract": ("", "BIMOTWbimotw", "AEHSUaehsu", "利基建引所提本构设通采"),
    "system_architecture": ("", "CIOTciot", "HOSUhosu", "分包总整由系网"),
    "algorithm_extract": ("", "ACGLOSTWacglostw", "BEHILOPRbehilopr", "优伪损收时梯目空算计迭"),
    "innovation_extract": ("", "FKMNOTUWfkmnotuw", "AEHNOUaehnou", "不与主创区我本核首"),
    "experiment_setup": ("", "ABEITVWabeitvw", "ABEHNRVXabehnrvx", "基实对数样测消训评验"),
    "experiment_result": ("", "AEFPRTaefprt", "1CEHMRXcehmrx", "准召均实查测精结误"),
    "performance_gain": ("", "BDGIORSTbdgiorst", "AEHMNOTUaehmnotu", "优减增提改相缩节超达降领"),
    "metric_indicator": ("", "BEFLMPRSTbeflmprst", "AEHINORUaehinoru", "信内功吞响带帧延时能误资运"),
    "figure_table_ref": ("", "FTft", "AIai", "图如表见"),
    "formula_extract": ("$", "E\\e", "BQbq", "公式"),
    "theorem_proof": ("", "ACILPSTWacilpstw", "EHORSTUehorstu", "假前命定引推满约证"),
    "implementation": ("", "IRUWiruw", "EMSUemsu", "代使在基"),
    "conclusion_extract": ("", "IOTWiotw", "EHNOUVehnouv", "可实得总本研结综"),
    "limitation_future": ("", "FILRfilr", "EINUeinu", "下不仍尚局有未进"),
    "generic_background": ("", "INORWinorw", "EINOTVeinotv", "众在如当近长随"),
    "importance_cliche": ("", "AHIPWahipw", "AILNSailns", "不具发受得扮至越"),
    "common_definition": ("", "CIRcir", "EOSeos", "一可所是通"),
    "redundant_transition": ("", "FIOSTfiost", "EHINSehins", "一其再另总最本然首"),
    "filler_hedge": ("", "AGINTWagintw", "ENOSTenost", "一不值在总显某相需"),
    "vague_prospect": ("", "HIOPhiop", "APRSaprs", "为具应提有"),
    "acknowledgment_funding": ("", "AFGTWafgtw", "CEHRUcehru", "国感本致衷课"),
    "statistical_significance": ("FPTfpt", "ACHSachs", "HNOTYhnoty", "假卡方显统置"),
    "hyperparameter_setting": ("", "ABDEFHLOSWabdefhlosw", "ADEGIPRYadegipry", "优参学批权正训轮迭隐"),
    "comparison_baseline": ("", "BCEIOSTbceiost", "EHNOUVXehnouvx", "与优对相"),
    "exaggeration": ("", "CDFGPRUcdfgpru", "AENORaenor", "前大完彻无极遥"),
    "tautology_verbose": ("", "IMSTimst", "HNOThnot", "严也亦从准换"),
}
#: Characters that a search without case takes for ASCII letters (i, i, s, k), and a range that holds them and all other letters.
FOLDED, BEYOND = "\u0130\u0131\u017f\u212a", "\u0080-\uffff"


def searched(rule: Rule) -> str:
    """The rule's pattern behind a look at two characters, which spares most places its many alternatives; the hits are the same.

    For Java's and Python's engines, to be searched without case.  Classes that all places meet are ASCII characters and
    one range, as Java asks for each character of a class beyond Latin-1 in turn.
    """
    one = lambda chars, more="": "[" + "".join("\\" + c if c in "\\$" else c for c in chars) + more + "]"
    alone, first, second, other = BEGINS[rule.name]
    places = [one(alone)] * bool(alone) + [one(first) + one(second, BEYOND)] * bool(first) + [f"(?=[{BEYOND}])" + one(other + FOLDED)]
    return f"(?-i:(?={one(alone + first, BEYOND)})(?={'|'.join(places)}))(?:{rule.pattern})"


#: How a rule's hits begin, in lower case and six characters at most: # a digit, _ white space, · any character. After a
#: shorter one, anything may follow.
OPENINGS = {
    "problem_motivation": "aim at|aim to|aimed |aims a|aims t|in ord|motiva|suffer|the pr|to add|to dea|to ove|to sol|to tac|为了克服|为了应对|为了缓解|为了解决|为克服|为应对|为缓解|为解决|存在|旨在|本文主要关注|本文主要研究|本文关注|本文研究|研究目标|针对|难以",
    "definition_notation": "denote|is def|we def|where|令|其中|定义|表示为|记为|设",
    "method_extract": "based |is pro|method|our ap|our me|our sc|the pr|we ado|we bui|we des|we dev|we emp|we int|we pro|we uti|利用|基于|建立|引入|所提方法|提出|本文方法|构建|设计|通过|采用",
    "system_architecture": "consis|is com|our fr|our pi|our sy|the ar|the fr|the ov|the pr|the wh|分为|包含|总体设计|整体架构|整体框架|整体流程|整体结构|由|系统架构|系统框架|系统结构|网络结构",
    "algorithm_extract": "algori|conver|gradie|loss f|object|optimi|space |the al|time c|we opt|优化目标|优化算法|优化问题|伪代码|损失函数|收敛|时间复杂度|梯度下降|梯度更新|目标函数|空间复杂度|算法#|算法_|算法描述|算法步骤|算法流程|计算复杂度|迭代更新|迭代求解|迭代过程",
    "innovation_extract": "for th|key co|key in|main c|novel|our co|the co|unlike|we pro|不同于|与|主要工作|主要贡献|创新点|区别于|我们提出|本文工作|核心创新|首次实现|首次引入|首次提出",
    "experiment_setup": "ablati|baseli|benchm|evalua|experi|in our|in the|test s|testin|the da|traini|valida|we car|we con|we per|基准方法|基准模型|实验参数|实验平台|实验条件|实验环境|实验设置|实验配置|对比实验|数据集|样本数|样本量|样本集|测试集|消融实验|消融研究|训练集|评价指标|评估指标|验证集",
    "experiment_result": "accura|achiev|experi|f1-sco|f1_sco|f1scor|precis|recall|result|rmse|the re|准确率|召回率|均方误差|实验结果显示|实验结果表明|实验结果证明|实验结果说明|实验表明|查全率|查准率|测试结果|精度|精确率|结果显示|结果表明|结果证明|结果说明|误差",
    "performance_gain": "boost_|boostd|booste|boosts|decrea|gain_|gaind_|gaines|gains_|improv|increa|outper|reduce|sota|state-|superi|surpas|the be|优于|减少#|减少_|减少了#|减少了_|增加#|增加_|增加了#|增加了_|提升#|提升_|提升了#|提升了_|提高#|提高_|提高了#|提高了_|改善#|改善_|改善了#|改善了_|相比|缩短#|缩短_|缩短了#|缩短了_|节省#|节省_|节省了#|节省了_|超过|达到|降低#|降低_|降低了#|降低了_|领先",
    "metric_indicator": "bandwi|bit er|energy|frame |latenc|memory|power |respon|runtim|signal|throug|信噪比|内存占用|功耗|吞吐率|吞吐量|响应时间|带宽|帧率|延迟|时延|能耗|误码率|资源利用率|运行时间",
    "figure_table_ref": "fig#|fig.#|fig._|fig_|figure|table#|table.|table_|图#|图_|如图#|如图_|如表#|如表_|表#|表_|见图#|见图_|见表#|见表_",
    "formula_extract": "$|\\begin|eq#|eq(#|eq.#|eq.(#|eq._|eq_|equati|公式#|公式(#|公式_|式(#|式_",
    "theorem_proof": "assume|coroll|it fol|lemma#|lemma_|propos|subjec|the pr|theore|we ass|we pro|假设#|假设_|前提条件|命题#|命题_|定理#|定理_|引理#|引理_|推论#|推论_|满足|约束条件|证明:|证明：",
    "implementation": "implem|is imp|run on|runs o|using |we imp|代码使用|代码基于|使用|在|基于",
    "conclusion_extract": "in con|in sum|our st|our wo|overal|this p|to con|to sum|we con|可以得出|实验充分证明|实验证明|得出结论|总的来说|本文实现|本文提出|本文构建|本文研究|本文设计|本文采用|本研究|研究表明|结论|综上",
    "limitation_future": "furthe|future|in fut|in the|leave|limita|remain|下一步|不足之处|仍存在|仍然存在|仍然面临|仍面临|尚存在|尚未|尚需|局限|有待完善|有待提高|有待改进|未来工作|未来方向|未来研究|进一步工作|进一步探索|进一步改进|进一步研究",
    "generic_background": "in rec|it is |nowada|over t|recent|with t|众所周知|在|如今|当今时代|当今社会|近年来|长期以来|随着",
    "importance_cliche": "an imp|has at|is of |play a|played|plays |widely|不可或缺|具有重大|具有重要|发挥|受到|得到了广泛关|得到了广泛应|得到了广泛的|得到了广泛研|得到广泛关注|得到广泛应用|得到广泛的关|得到广泛的应|得到广泛的研|得到广泛研究|扮演|至关重要|越来越",
    "common_definition": "common|is a k|is a t|refer |referr|refers|一般指的是|一般是指|可以理解为|可以看作|所谓|是指|通常指的是|通常是指",
    "redundant_transition": "finall|firstl|is org|on the|second|the re|the st|thirdl|一方面|其次|再次|另一方面|总而言之|最后|本文余下部分|本文其余部分|本文剩余部分|本文的组织如|本文的组织安|本文的结构如|本文的结构安|本文组织如下|本文组织安排|本文结构如下|本文结构安排|本章主要介绍|本章主要讨论|本章主要阐述|本章介绍|本章讨论|本章阐述|然后|首先",
    "filler_hedge": "as des|as dis|as ill|as men|as not|as see|as sho|genera|in gen|it can|it cou|it is |it may|it sho|note t|notice|to som|we can|we cou|一般来说|不难发现|不难得到|不难看出|值得一提的是|值得指出的是|值得注意的是|在一定程度上|总体而言|显而易见|某种程度上|相对而言|需要指出的是|需要注意的是|需要说明的是",
    "vague_prospect": "has br|has gr|has wi|is pro|open n|open u|opens |pave t|paves |provid|为|具有|应用前景|提供|有望",
    "acknowledgment_funding": "acknow|funded|grant |this w|we tha|we wou|国家自然科学|感谢|本工作受|本工作得到|本文受|本文得到|本研究受|本研究得到|致_|致谢|衷心感谢|课题支持|课题资助",
    "statistical_significance": "anova|chi-sq|confid|f_|f检验|hypoth|p-valu|p<.#|p<0.#|p<_|p=.#|p=0.#|p=_|p>.#|p>0.#|p>_|p_|pvalue|standa|statis|t-test|t_|t检验|假设检验|卡方检验|方差分析|显著差异|显著性差异|显著性检验|显著性水平|统计上显著|统计学上显著|统计学显著|统计显著|置信区间|置信水平",
    "hyperparameter_setting": "adam|batch_|batchs|dropou|epoch|fine-t|finetu|hidden|hyper-|hyperp|learni|optimi|sgd|weight|优化器|参数初始化|学习率|学习速率|批大小|批尺寸|批量大小|权重衰减|正则化系数|训练轮数|轮次为|迭代次数|迭代轮数|隐藏层",
    "comparison_baseline": "beat|compar|exceed|in com|outper|over b|over e|over t|surpas|than b|than e|than p|than t|与|优于|对比|相比之下|相比于",
    "exaggeration": "comple|dramat|far be|far su|greatl|perfec|remark|unprec|前所未有|大大减少|大大地减少|大大地增强|大大地提升|大大地提高|大大地改善|大大地缩短|大大地降低|大大增强|大大提升|大大提高|大大改善|大大缩短|大大降低|完全优于|完全解决|完全超越|完美地契合|完美地实现|完美地解决|完美契合|完美实现|完美解决|彻底地改变|彻底地消除|彻底地解决|彻底改变|彻底消除|彻底解决|无可比拟|极其优异|极其出色|极其重要|极大地|极大程度上|遥遥领先",
    "tautology_verbose": "in oth|more p|strict|that i|to put|严格地说|严格来说|也就是说|亦即|从某种意义上|从某种程度上|准确地说|准确说|换个角度看|换个角度说|换句话说|换言之",
}

KEEP = [r.name for r in RULES if r.action == "keep"]
