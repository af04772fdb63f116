"""Training rows from papers: weak labels, dedup, caps, splits, and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import NEGATIVE, POSITIVE, SECTION_OF
from ..functions.rowwise import unnested
from .clean import norm_text, sentence_like, sentences
from .rules import first_rule

SECTION_TASK, CORE_TASK, DENOISE_TASK = "section", "is_core", "denoise"
LABELS = ["引言", "方法", "实验", "结论"]


def weak_labels(papers: DataFrame, per_paper: int = 60, denoise: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(instruction, input, output, _paper): labels that the first matching rule gives to a paper's sentences.

    A paper's sentences are taken once each, in order; the first ``per_paper`` with a rule count.
    """
    said = unnested(papers, [id_col], sentences(F.coalesce("text", F.lit(""))), "pos", "s").where(sentence_like(F.col("s"), terminal=True))
    once = said.groupBy(id_col, "s").agg(F.min("pos").alias("pos"))
    ruled = unnested(once, [id_col, "s", "pos"], F.array(first_rule(F.col("s"))), "r")  # a filter on the rule would be pushed down, and run the rules twice
    kept = ruled.withColumn("k", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("k") <= per_paper)
    rule = F.col("r.rule")
    section = F.coalesce(*[F.when(rule.isin(*[r for r, s in SECTION_OF.items() if s == label]), F.lit(label)) for label in LABELS])
    core = F.when(rule.isin(*POSITIVE), "是").when(rule.isin(*NEGATIVE), "否")
    is_keep = F.col("r.action") == "keep"
    rows = [F.struct(F.lit(SECTION_TASK).alias("instruction"), F.when(is_keep, section).alias("output")), F.struct(F.lit(CORE_TASK).alias("instruction"), F.when(is_keep, core).alias("output"))]
    if denoise:
        rows.append(F.struct(F.lit(DENOISE_TASK).alias("instruction"), F.when(is_keep, "核心").otherwise("可精简").alias("output")))
    each = kept.select(id_col, "s", F.explode(F.array(*rows)).alias("t")).where("t.output is not null")
    return each.select("t.instruction", F.col("s").alias("input"), "t.output", F.col(id_col).cast("string").alias("_paper"))


def gold_labels(gold: DataFrame, rules: Column | None = None) -> DataFrame:
    """Rows from human labels: gold(paper, core array<string>, candidates array<string>).

    Core sentences are positive; candidates that are not core and that a non-method rule matches are
    negative; with 2 to 12 candidates the first core sentence among them is to be picked.
    """
    core = gold.select("paper", F.explode("core").alias("s")).distinct()
    positive = core.select(F.lit(CORE_TASK).alias("instruction"), F.col("s").alias("input"), F.lit("是").alias("output"), F.col("paper").alias("_paper"))
    others = gold.select("paper", F.explode("candidates").alias("s")).distinct().join(core, ["paper", "s"], "left_anti")
    matched = others.withColumn("r", first_rule(F.col("s"))).where(F.col("r.rule").isin(*NEGATIVE))
    negative = matched.select(F.lit(CORE_TASK).alias("instruction"), F.col("s").alias("input"), F.lit("否").alias("output"), F.col("paper").alias("_paper"))
    pool = gold.where(F.size("candidates").between(2, 12)).withColumn("best", F.get(F.filter("candidates", lambda c: F.array_contains(F.col("core"), c)), 0)).where("best is not null")
    pick = pool.select(F.lit("pick_core").alias("instruction"), F.array_join("candidates", "\n").alias("input"), F.col("best").alias("output"), F.col("paper").alias("_paper"))
    return positive.unionByName(negative).unionByName(pick)


def dedup_rows(rows: DataFrame) -> DataFrame:
    """One row per (instruction, input, output): the one of the smallest paper."""
    return rows.groupBy("instruction", "input", "output").agg(F.min("_paper").alias("_paper"))


def cap_per_class(rows: DataFrame, cap: int = 90) -> DataFrame:
    """At most ``cap`` rows per (instruction, output), in the order of a hash.

    The cap is the operator's purpose.  Each of 64 hash slices is cut first, so no class is sorted in one task.
    """
    order = [F.md5(F.concat_ws("\x01", "instruction", "input", "output")), "input"]
    slices = rows.withColumn("_h", order[0]).withColumn("_slice", F.substring("_h", 1, 2))
    part = Window.partitionBy("instruction", "output", "_slice").orderBy("_h", "input")
    cut = slices.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= cap)
    whole = Window.partitionBy("instruction", "output").orderBy("_h", "input")
    return cut.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= cap).drop("_h", "_slice", "_r")


def split_by_paper(rows: DataFrame, share: float = 0.1) -> DataFrame:
    """``rows`` with ``split``: whole papers go to val, in the order of a hash, until ``share`` of the rows is there.

    Papers are summed up in slices of the hash; only the sums of slices (4096 rows at most) meet in one
    window, and papers are put in order within their slice.
    """
    own = rows.where("_paper <> '_synthetic'").groupBy("_paper").agg(F.count(F.lit(1)).alias("n")).withColumn("_h", F.md5("_paper"))
    sizes = own.withColumn("_slice", F.substring("_h", 1, 3))
    total = rows.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("target"))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sizes.groupBy("_slice").agg(F.sum("n").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    slices = slices.crossJoin(F.broadcast(total)).where("_ahead < target")  # total: a single row
    before = Window.partitionBy("_slice").orderBy("_h", "_paper").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(F.broadcast(slices), "_slice").withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    marked = rows.join(placed.where("_before < target").select("_paper", F.lit(True).alias("_val")), "_paper", "left")
    return marked.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("instruction", "output").agg(F.count(F.lit(1)).alias("n"))


def earliest(text: Column, labels: list[str]) -> Column:
    """The label that comes first in a text; null if none does."""
    places = F.array(*[F.struct(F.instr(text, x).alias("at"), F.lit(i).alias("ord"), F.lit(x).alias("label")) for i, x in enumerate(labels)])
    return F.get(F.array_sort(F.filter(places, lambda p: p["at"] > 0)), 0)["label"]


def yes_no(text: Column) -> Column:
    t = F.trim(text)
    head, three = F.substring(t, 1, 6), F.lower(F.substring(t, 1, 3))
    no = F.contains(head, F.lit("不是")) | F.startswith(t, F.lit("否")) | F.startswith(t, F.lit("不")) | F.startswith(three, F.lit("no"))
    yes = F.startswith(t, F.lit("是")) | F.contains(head, F.lit("是的")) | F.startswith(three, F.lit("yes"))
    return F.when(no, "否").when(yes, "是").otherwise(earliest(t, ["是", "否"]))


def parse_label(output: Column, gold: Column) -> Column:
    """A model's answer as a label of the gold's kind."""
    return F.when(gold.isin("是", "否"), yes_no(output)).when(gold.isin(*LABELS), earliest(output, LABELS)).otherwise(F.trim(output))


def metrics(pairs: DataFrame, by: list[str], positive: str = "是") -> DataFrame:
    """Accuracy, and precision, recall and F1 of the positive label, of pairs (pred, gold)."""
    tp, fp, fn = (F.sum(F.when(c, 1).otherwise(0)) for c in (
        (F.col("pred") == positive) & (F.col("gold") == positive),
        (F.col("pred") == positive) & (F.col("gold") != positive),
        ~F.col("pred").eqNullSafe(positive) & (F.col("gold") == positive),
    ))
    rows = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.trim("pred") == F.trim("gold")).cast("int")).alias("right"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = rows.withColumn("p", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = rate(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return rows.select(*by, "n", F.round(F.coalesce("right", F.lit(0)) / F.col("n"), 6).alias("accuracy"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def split_rows(rows: DataFrame, share: float = 0.1) -> DataFrame:
    """``rows`` with ``split`` by a hash of each row, about ``share`` to val; rows of one paper may part (``split_by_paper`` keeps them together)."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("\x01", "instruction", "input", "output")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("split", F.when(draw < F.lit(int(share * 16**8)), "val").otherwise("train"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """gold(paper, core, candidates) of a folder of JSON files; broken files are left out, white space is one blank."""
    schema = "gold_core_sentences array<string>, candidates array<string>, candidate_sentences array<string>"
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("paper"), F.from_json("value", schema).alias("g"))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm_text), lambda s: s != "")
    some = F.filter(clean(F.coalesce("g.candidates", "g.candidate_sentences")), lambda s: sentence_like(s))
    return texts.where("g.gold_core_sentences is not null or g.candidates is not null or g.candidate_sentences is not null").select("paper", clean(F.col("g.gold_core_sentences")).alias("core"), some.alias("candidates"))


def without_names(files: DataFrame, names: list[str] | DataFrame, name_col: str = "filename") -> DataFrame:
    """``files`` but for some names (a short list, or a table with a column of that name)."""
    if isinstance(names, DataFrame):
        return files.join(names.select(name_col).distinct(), name_col, "left_anti")
    return files.where(~F.col(name_col).isin(*names)) if names else files
