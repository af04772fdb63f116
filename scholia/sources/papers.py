"""Readers of texts, and short papers composed from the part table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One SQL expression for both engines: a paper with or without each section, by p_partkey, some in other languages.
PAPER_TEXT = """
CASE WHEN p_partkey % 13 = 3 THEN '摘要' || chr(10) || '针对 ' || p_name || ' 的问题，本文提出了一种新方法。随着技术的发展，' || p_brand || ' 得到了广泛关注。众所周知，它很重要。' || chr(10) || '关键词：' || p_name || '；' || p_brand || chr(10)
|| '研究方法' || chr(10) || '损失函数定义为 $L_{' || CAST(p_size AS STRING) || '} = 0.' || CAST(p_size AS STRING) || '$，其中 x 表示输入。基于 PyTorch 框架实现，在 GPU 上训练，学习率为 0.' || CAST(p_size AS STRING) || '。定理 1 成立。首先介绍模型。' || chr(10)
|| CASE WHEN p_partkey % 2 = 0 THEN '实验结果' || chr(10) || '如表 ' || CAST(p_size % 9 AS STRING) || ' 所示，准确率提高了 ' || CAST(p_size AS STRING) || '.5%，差异显著（p < 0.05）。所谓 ' || p_name || ' 是指一种零件。' || chr(10) ELSE '' END
|| '结论' || chr(10) || '综上所述，' || p_name || ' 优于现有方法，准确率为 ' || CAST(p_size AS STRING) || '.5%。为后续研究提供参考，应用前景广阔。换句话说，效果很好。' || chr(10) || '致谢' || chr(10) || '感谢国家自然科学基金的资助。'
WHEN p_partkey % 13 = 5 THEN '要旨' || chr(10) || '本研究では ' || p_name || ' の新しい手法を提案する。' || p_brand || ' のモデルは高い精度を示した。' || chr(10) || 'キーワード：' || p_name || chr(10) || '提案手法' || chr(10) || p_name || ' のアルゴリズムは損失関数を最小化し、学習率は 0.' || CAST(p_size AS STRING) || ' である。' || chr(10)
|| CASE WHEN p_partkey % 2 = 0 THEN '評価実験' || chr(10) || '精度は ' || CAST(p_size AS STRING) || '.5% であり、遅延は ' || CAST(p_size AS STRING) || ' ms だった。データセットは公開されている。' || chr(10) ELSE '' END || 'おわりに' || chr(10) || p_name || ' の精度は ' || CAST(p_size AS STRING) || '.5% に達し、提案手法の有効性を確認した。'
WHEN p_partkey % 13 = 7 THEN '초록' || chr(10) || '본 논문은 ' || p_name || ' 문제를 위한 새로운 방법을 제안한다. ' || p_brand || ' 모델을 사용하였다.' || chr(10) || '키워드: ' || p_name || chr(10) || '제안 방법' || chr(10) || p_name || ' 알고리즘은 손실 함수를 최소화하며 학습률은 0.' || CAST(p_size AS STRING) || ' 이다. 모델은 두 단계로 구성된다.' || chr(10)
|| '실험 결과' || chr(10) || '정확도는 ' || CAST(p_size AS STRING) || '.5% 이고 지연은 ' || CAST(p_size AS STRING) || ' ms 였다. 데이터는 공개되어 있다.' || chr(10) || '결론' || chr(10) || p_name || ' 의 정확도는 ' || CAST(p_size AS STRING) || '.5% 에 도달하였고 유효성을 확인하였다.'
WHEN p_partkey % 13 = 9 THEN 'Zusammenfassung' || chr(10) || 'Diese Arbeit stellt ein neuartiges Verfahren für ' || p_name || ' vor. Das Modell ' || p_brand || ' wird geprüft.' || chr(10) || 'Schlüsselwörter: ' || p_name || ', ' || p_brand || chr(10) || 'Methodik' || chr(10) || 'Der Algorithmus minimiert die loss function mit learning rate 0.' || CAST(p_size AS STRING) || '. Die Übertragung läuft über ' || p_name || '.' || chr(10)
|| 'Ergebnisse' || chr(10) || 'Die Genauigkeit beträgt ' || CAST(p_size AS STRING) || '.5% bei ' || CAST(p_size AS STRING) || ' ms. Größere Datensätze folgen.' || chr(10) || 'Fazit' || chr(10) || 'Das Verfahren erreicht ' || CAST(p_size AS STRING) || '.5% auf ' || p_name || ' und ist damit robust.'
WHEN p_partkey % 13 = 11 THEN 'Abstract' || chr(10) || 'The loss is denoted by $L_{1} = x^2$ and Eq. (' || CAST(p_size % 9 AS STRING) || ') holds. Theorem ' || CAST(p_size % 9 AS STRING) || ' is subject to ' || p_name || '. Table ' || CAST(p_size % 9 AS STRING) || ' lists results for ' || p_brand || '.' || chr(10)
|| '2 Approach' || chr(10) || 'It is implemented in Java. Firstly, ' || p_name || ' is a kind of part. It provides a new perspective.' || chr(10) || '3 Results' || chr(10) || 'The confidence interval of ' || CAST(p_size AS STRING) || '.5% is narrow, the p-value small.' || chr(10) || 'Conclusion' || chr(10) || 'In summary, ' || p_name || ' gains ' || CAST(p_size AS STRING) || '.5%. We thank the reviewers of ' || p_brand || '.'
WHEN p_partkey % 7 = 0 THEN 'The ' || p_name || ' framework model near the river was quiet. Nobody came. An analysis of ' || p_name || ' performance!' || chr(10) || 'Short one.'
ELSE 'Abstract' || chr(10) || 'We propose a novel ' || lower(p_type) || ' scheme to address the ' || p_name || ' problem. In recent years, ' || p_brand || ' has attracted much attention.' || chr(10)
|| CASE WHEN p_partkey % 3 <> 0 THEN 'Keywords: ' || p_name || ', ' || p_brand || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 4 <> 1 THEN '2 Method' || chr(10) || 'Our approach builds a ' || p_name || ' model. The loss function converges with learning rate 0.' || CAST(p_size AS STRING) || '. It consists of ' || CAST(p_size % 9 AS STRING) || ' layers.' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 5 <> 2 THEN '3 Results' || chr(10) || 'Experimental results show accuracy ' || CAST(p_size AS STRING) || '.5% and latency ' || CAST(p_size AS STRING) || ' ms on the dataset. It outperforms ' || CAST(p_partkey % 50 + 10 AS STRING) || ' baselines.' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 2 = 0 THEN '4 Conclusion' || chr(10) || 'In conclusion, we achieve ' || CAST(p_size AS STRING) || '.5% accuracy on ' || p_name || ' data. Future work remains open.' || chr(10) ELSE '' END
|| CASE WHEN p_partkey % 6 = 1 THEN 'It is worth noting that ' || p_brand || ' greatly helps. In other words, nothing else.' || chr(10) ELSE '' END
END"""


#: Rows of a partition of papers, so that the longest task doesn't grow with their table.
DEALT = 1 << 14


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly, in four partitions for each core at least and of ``DEALT`` rows at most; costly expressions follow.

    The number of splits doesn't tell how rows are dealt: a Parquet file's rows come with the split that has the
    middle of their row group, so a million short rows may be in one split of many.
    """
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DEALT)))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a paper for each part."""
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    return parts.select(F.col("p_partkey").alias("doc_id"), F.expr(PAPER_TEXT).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Characters that composed Han words are made of.
HAN = "".join(chr(0x4E00 + 20 * k) for k in range(1024))
#: What such a text is made from: words in letters, and ends of sentences; and what lies between.
HAN_TOKENS, HAN_BLANKS = r"\p{L}+|[.!?;]", r"[^\p{L}.!?;]+"


def han_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the documents in Han characters without blanks.

    A word becomes one to three characters by its digest, the same ones wherever it occurs; sentences keep
    their ends, so words are known and the text doesn't show them.
    """
    alphabet = F.array(*[F.lit(c) for c in HAN])
    # 32 bits of the digest: two for the number of characters, ten for each of three; -1 ends a sentence.
    number = lambda w: F.when(w.isin(*".!?;"), F.lit(-1)).otherwise(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"))
    char = lambda x, k: F.element_at(alphabet, (F.shiftright(x, 2 + 10 * k) % len(HAN) + 1).cast("int"))

    def word(x: Column) -> Column:
        size = x % 4
        two = F.concat(char(x, 0), char(x, 1))
        return F.when(x < 0, F.lit("。")).when(size == 0, char(x, 0)).when(size < 3, two).otherwise(F.concat(two, char(x, 2)))

    said = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), HAN_BLANKS, " ")
    return documents(spark, sf_dir).select("doc_id", said.alias("text")).mapInArrow(_composed, "doc_id long, text string")


class _Composed(dict):
    """What words and ends of sentences between blanks become; the first 2^18 are remembered, frequent words among them."""

    def __missing__(self, said: str) -> str:
        word = said.rstrip(".!?;")
        if any(end in word for end in ".!?;"):
            out = "".join(self[w] for w in re.findall("[.!?;]|[^.!?;]+", said))
        elif word == said:
            out = _han_word(said) if said else ""
        else:
            out = (self[word] if word else "") + "。" * (len(said) - len(word))
        if len(self) < 1 << 18:
            self[said] = out
        return out


def _han_word(word: str) -> str:
    """32 bits of the digest: two for the number of characters, ten for each of three."""
    x = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big")
    a, size = HAN[x >> 2 & 1023], x & 3
    if not size:
        return a
    return a + HAN[x >> 12 & 1023] if size < 3 else a + HAN[x >> 12 & 1023] + HAN[x >> 22]


def _composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Composed()
    for batch in batches:
        texts = ["".join(map(known.__getitem__, t.split(" "))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole UTF-8 files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples of a JSON-lines file; blank and broken lines are skipped."""
    return spark.read.schema("instruction string, input string, output string").option("mode", "DROPMALFORMED").json(path)


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length, content) of uploaded files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; '' without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def allowed(name: Column) -> Column:
    return extension(name).isin("pdf", "docx", "txt", "md")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Training rows as JSON lines, without internal columns (those that begin with an underscore)."""
    rows.drop(*[c for c in rows.columns if c.startswith("_")]).write.mode("overwrite").json(path)
