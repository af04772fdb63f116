"""Roll-ups: overview, history, report, library of documents, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import original_name
from .score import DIMENSIONS, first_suggestion, level


def overview(scored: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: total, level, strongest, weakest, keeps, salience in percent, two suggestions."""
    keeps = hits.where("action = 'keep'").groupBy(id_col).agg(F.count(F.lit(1)).alias("keeps"), F.bround(F.round(F.avg("salience") * 100, 6)).cast("int").alias("salience_pct")).hint("merge")  # as large as the documents, which Spark's size check takes for small
    low = F.array_sort(F.array(*[F.struct(F.col(d).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("name"), first_suggestion(d).alias("tip")) for i, d in enumerate(DIMENSIONS)]))
    high = F.array_sort(F.array(*[F.struct((-F.col(d)).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("name")) for i, d in enumerate(DIMENSIONS)]))
    rows = scored.withColumn("low", low).withColumn("high", high).join(keeps, id_col, "left")
    tips = F.array_join(F.transform(F.slice("low", 1, 2), lambda x: x["tip"]), "; ")
    return rows.select(
        id_col,
        "total",
        level(F.col("total")).alias("level"),
        F.element_at("high", 1)["name"].alias("strongest"),
        F.element_at("low", 1)["name"].alias("weakest"),
        F.coalesce("keeps", F.lit(0)).cast("long").alias("keeps"),
        "salience_pct",
        tips.alias("suggestions"),
    )


def history_summary(records: DataFrame) -> DataFrame:
    """Summaries of analyses (id, timestamp, filename, analysis_mode, text_length, keep_count, match_count, salience_avg, ...), newest first."""
    return records.select(
        "id",
        "timestamp",
        F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm").alias("time_str"),
        F.coalesce(F.nullif("filename", F.lit("")), F.lit("未知文件")).alias("filename"),
        F.coalesce(F.nullif("analysis_mode", F.lit("")), F.lit("structured")).alias("analysis_mode"),
        F.coalesce("text_length", F.lit(0)).cast("long").alias("text_length"),
        F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"),
        F.coalesce("keep_count", F.lit(0)).cast("long").alias("keep_count"),
        F.bround("salience_avg", 3).alias("salience_avg"),
    ).orderBy(F.desc("timestamp"), F.desc("id"))


def report_text(scored: DataFrame, hits: DataFrame, id_col: str = "doc_id", title: str = "Analysis report", markdown: bool = True) -> DataFrame:
    """(id, report): score by dimension and keep hits by salience (ties by rule and position)."""
    key = F.struct((-F.col("salience")).alias("s"), "ord", "n", "rule", "hit")
    keeps = hits.where("action = 'keep'").groupBy(id_col).agg(F.array_sort(F.collect_list(key)).alias("found")).hint("merge")  # a document's own hits; all of them together are no table to broadcast
    bullet, head, sub = ("- ", "# ", "\n## ") if markdown else ("  · ", "", "\n")
    line = lambda x: F.concat(F.lit(bullet), F.lit("["), F.bround(F.round(-x["s"] * 100, 6)).cast("int").cast("string"), F.lit("%] "), x["rule"], F.lit(": "), F.regexp_replace(x["hit"], r"\s+\z", ""))
    parts = [F.lit(head + title), F.concat(F.lit(bullet + "length: "), F.col("text_length").cast("string")), F.concat(F.lit(sub + "Score "), F.col("total").cast("string"), F.lit("/100"))]
    parts += [F.concat(F.lit(f"{bullet}{d}: "), F.col(d).cast("string"), F.lit("/25")) for d in DIMENSIONS]
    lines = F.concat(F.array(*parts), F.when(F.size("found") > 0, F.concat(F.array(F.lit(sub + "Core passages")), F.transform("found", line))).otherwise(F.array().cast("array<string>")))
    rows = scored.join(keeps, id_col, "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<s:double,ord:int,n:int,rule:string,hit:string>>)")))
    return rows.select(id_col, F.array_join(lines, "\n").alias("report"))


def latest_per(rows: DataFrame, key: str, newest: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times go to the smaller ``tie``."""
    order = Window.partitionBy(key).orderBy(F.desc(newest), tie)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def doc_library(files: DataFrame, names: DataFrame, analyses: DataFrame) -> DataFrame:
    """Newest file per original name with the number of its analyses, newest first.

    files(safe_name, modified, size), names(safe_name, original), analyses(filename).
    """
    counts = analyses.where("filename <> ''").groupBy("filename").agg(F.count(F.lit(1)).alias("analyzed_count"))
    rows = files.join(names, "safe_name", "left").withColumn("filename", F.coalesce(F.nullif("original", F.lit("")), original_name(F.col("safe_name"))))
    newest = latest_per(rows.select("safe_name", "filename", "size", "modified"), "filename", "modified", "safe_name")
    joined = newest.join(counts, "filename", "left")
    return joined.select("filename", "safe_name", "size", "modified", F.coalesce("analyzed_count", F.lit(0)).cast("long").alias("analyzed_count")).orderBy(F.desc("modified"), "filename")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``existing`` and those of ``new`` whose key is not there yet, one row a key (the first by ``order``)."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"))


def insert_or_replace(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new``, and those of ``existing`` whose key it doesn't have."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def record_stats(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a record keeps of its hits: id, match_count, keep_count, salience_avg (half to even, three places)."""
    keeps = F.count_if(F.col("action") == "keep")
    return hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("match_count"), keeps.alias("keep_count"), F.bround(F.round(F.avg("salience"), 9), 3).alias("salience_avg"))


def translated(labels: DataFrame, words: DataFrame, lang: str, label_col: str = "label") -> DataFrame:
    """``labels`` with ``shown``: the label's translation into a language, else the label itself.

    words(label, lang, text) is a table of labels of an interface, one text each; Spark broadcasts it if it is small.
    """
    own = words.where(F.col("lang") == lang).select(F.col("label").alias(label_col), F.col("text").alias("_shown"))
    return labels.join(own, label_col, "left").withColumn("shown", F.coalesce("_shown", label_col)).drop("_shown")


def upload_name(ts: Column, name: Column) -> Column:
    """Time stamp, the name's letters, digits, dots and dashes before the last dot, and the extension in lower case."""
    base = F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)
    kept = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9_.\x{4e00}-\x{9fff}-]+", "_"), r"^[._]+|[._]+$", "")
    extension = F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise(F.lit(""))
    return F.concat(ts.cast("string"), F.lit("_"), F.coalesce(F.nullif(kept, F.lit("")), F.lit("file")), extension)
