"""Strings as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = Column


def fmt(x: C) -> C:
    """A value as text."""
    return x.cast("string")


def pad(x: C, n: int) -> C:
    """To n characters on the left side, or for negative n on the right side; too long ones lose the far end."""
    if n >= 0:
        return F.rpad(x, n, " ")
    return F.lpad(F.when(F.length(x) > -n, F.right(x, F.lit(-n))).otherwise(x), -n, " ")


def split(x: C, separator: str) -> C:
    """Pieces between separators, empty ones too."""
    return F.split(x, re.escape(separator), -1)


def join(pieces: C, separator: str) -> C:
    """T3"""
    return F.array_join(pieces, separator)


def lower(x: C) -> C:
    """T4: A-Z only."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upper(x: C) -> C:
    """T4: a-z only."""
    return F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def index_of(x: C, part: str) -> C:
    """T5: where part begins, from 0; the length where it does not occur."""
    at = F.instr(x, part)
    return F.when(at == 0, F.length(x)).otherwise(at - 1)


def test(x: C, pattern: str) -> C:
    """Whether the whole text matches."""
    return F.regexp(x, F.lit(rf"\A(?:{pattern})\z"))


def regex_find(x: C, pattern: str) -> C:
    """Where the first match begins, from 0; null without one."""
    at = F.regexp_instr(x, F.lit(pattern))
    return F.when(at > 0, at - 1)


def regex_all(x: C, pattern: str) -> C:
    """All matches."""
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def sub(x: C, pattern: str, new: str) -> C:
    """The first match replaced; new is literal."""
    quoted = new.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(x, rf"(?s)\A(.*?)(?:{pattern})", "$1" + quoted)


def sub_all(x: C, pattern: str, new: str) -> C:
    """All matches replaced; new is literal."""
    return F.regexp_replace(x, pattern, new.replace("\\", r"\\").replace("$", r"\$"))


def tokens(x: C) -> C:
    """Runs of characters other than blanks."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: term, key, place of each token."""
    return df.select(F.col(key), F.posexplode(tokens(F.lower(text))).alias("place", "term")).select("term", key, F.col("place").cast("bigint").alias("place"))


def bm25(df: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """T8, extension: the documents that have a term of the query, by BM25 score. Only the query's terms are counted."""
    docs = df.select(F.col(key), tokens(F.lower(text)).alias("w")).withColumn("len", F.size("w"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    hits = docs.select(key, "len", F.explode("w").alias("term")).filter(F.col("term").isin(query)).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df_ = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (stats["mean"] or 1.0)))
    return hits.join(df_, "term").groupBy(key).agg(F.sum(idf * weight).alias("score"))


def zeros(x: C, n: int) -> C:
    """A number with leading zeros."""
    return F.lpad(x.cast("string"), n, "0")


def decimals(x: C, n: int) -> C:
    """A number with n decimals."""
    return F.format_string(f"%.{n}f", x.cast("double"))


def percent(x: C, n: int = 0) -> C:
    """A share as a percentage."""
    return F.format_string(f"%.{n}f%%", x.cast("double") * 100)
