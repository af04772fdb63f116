"""Licence scans by canonical digest, in DataFrame operations only.

A whole text is brought to a canonical form (A-Z lower-cased, copyright lines dropped, every run of
ASCII characters other than letters and digits made a separator, equivalent spellings made one) and
its SHA-256 is hash-joined to the digests of known licences in the same form.  The known digests are
a table of constants, a few dozen rows, and are broadcast; documents are neither shuffled nor sorted.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .licence_texts import KNOWN
from .scratch import quoted

#: Lines that only say who holds the rights (`(?d)`: only \n ends a line).
COPYRIGHT_LINE = r"^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|:|by[ \t]|[0-9]{4}|<year>|\[year\])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
SEPARATOR = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Words that matching guidelines for licences treat as equivalent, and the form that is kept.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "noncommercial": "non  commercial",
    "offence": "offense",
    "organisation": "organization",
    "percent": "per  cent",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "sub  license": "sublicense",
    "sub  licence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "copyright  owner": "copyright  holder",
    "copyright  owners": "copyright  holders",
    "https": "http",
}


def canonical(text: Column) -> Column:
    """The canonical form: words with a space on either side; null counts as empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, "(?dm)" + COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, SEPARATOR, "  "), F.lit(" "))
    for word, kept in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {kept} "))
    return F.trim(out)


def canonical_py(text: str) -> str:
    """``canonical`` for one string, to digest known texts."""
    out = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text)
    out = re.sub(COPYRIGHT_LINE, "", out, flags=re.M)
    out = " " + re.sub(r"[^a-z0-9\x80-\U0010ffff]+", "  ", out) + " "
    for word, kept in SPELLINGS.items():
        out = out.replace(f" {word} ", f" {kept} ")
    return out.strip(" ")


def known_digests(known: dict[str, list[str]] | None = None) -> dict[str, str]:
    """{digest of the canonical form: licence id}; where texts coincide the first id holds."""
    out: dict[str, str] = {}
    for name, texts in (known or KNOWN).items():
        for text in texts:
            out.setdefault(hashlib.sha256(canonical_py(text).encode()).hexdigest(), name)
    return out


def known_table(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """A table of constants (a local relation): known_sha256, license_id."""
    rows = ", ".join(f"('{digest}', '{name}')" for digest, name in sorted(known_digests(known).items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(known_sha256, license_id)")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, canon_sha256, n_canon long, license_id (null if unknown).

    Null and empty texts, and texts of nothing but separators and copyright lines, share the digest
    of the empty form, which is no licence.  Null or repeated ids give a row each.  Other columns are
    ignored.  An empty table gives no rows.
    """
    form = docs.select(F.col(quoted(id_col)).alias("id"), canonical(F.col(quoted(text_col))).alias("form"))
    # Both digest and length read the form; the barrier of a generator keeps it from being computed twice.
    form = form.select("id", F.explode(F.array("form")).alias("form"))
    hashed = form.select("id", F.sha2(F.col("form").cast("binary"), 256).alias("canon_sha256"), F.length("form").cast("long").alias("n_canon"))
    out = hashed.join(F.broadcast(known_table(docs.sparkSession, known)), F.col("canon_sha256") == F.col("known_sha256"), "left")
    return out.select(F.col("id").alias(id_col), "canon_sha256", "n_canon", "license_id")


def scan_sql() -> str:
    """The same in DuckDB's SQL over the table documents."""
    form = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', '', 'g')"
    form = f"' ' || regexp_replace({form}, '{SEPARATOR}', '  ', 'g') || ' '"
    for word, kept in SPELLINGS.items():
        form = f"replace({form}, ' {word} ', ' {kept} ')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    return (
        f"WITH known(known_sha256, license_id) AS (VALUES {rows}), f AS (SELECT doc_id, trim({form}, ' ') AS form FROM documents) "
        "SELECT doc_id, sha256(form) AS canon_sha256, length(form)::BIGINT AS n_canon, license_id "
        "FROM f LEFT JOIN known ON sha256(form) = known_sha256"
    )
