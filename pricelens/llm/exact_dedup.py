"""Exact deduplication by skew-safe combining.

Stages: (1) each task combines its own equal texts, (2) salted digest groups are merged, so copies of one text meet
in `salts` groups instead of one, (3) the winners of the salts are merged over all. Every stage groups by the text
itself next to its digest, so a digest collision never merges different texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def _keys(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [whole.alias("text"), F.sha2(whole, 256).alias("digest"), F.md5(whole).alias("check"), F.octet_length(whole).alias("bytes")]


def _salt(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).alias("salt")


def text_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, check, bytes, keep_id, group_size. Null texts count as empty."""
    rows = docs.select("doc_id", *_keys(F.col("text")), _salt(F.col("doc_id"), salts))
    salted = rows.groupBy("digest", "check", "bytes", "salt", "text").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "check", "bytes", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged.drop("text")


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of equal texts stays; a group of null ids alone keeps the null id. A row repeated with its id
    counts in group_size each time and carries the same decision. No rows in, no rows out; other columns are not read.
    The groups come back to the rows by SHA-256, MD5 and length, without moving the texts again.
    """
    groups = text_groups(docs, salts)
    rows = docs.select("doc_id", *_keys(F.col("text"))).drop("text")
    return rows.join(groups, ["digest", "check", "bytes"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, one per distinct text, with all columns of `docs` as they were.

    The row itself is carried as the winner's value, so that rows repeated whole leave one row too; of rows with
    equal id and text, any one stays.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*_keys(F.col("text")), _salt(F.col("doc_id"), salts), F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("rank"),
                       F.struct(*others, F.col("text").isNull().alias("had_no_text_")).alias("row"))
    salted = rows.groupBy("digest", "check", "bytes", "salt", "text").agg(F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
    merged = salted.groupBy("digest", "check", "bytes", "text").agg(F.max_by("row", "rank").alias("row"))
    return merged.select(*[F.when(~F.col("row.had_no_text_"), F.col("text")).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
