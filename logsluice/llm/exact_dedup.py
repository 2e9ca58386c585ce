"""Exact deduplication by content hash, in DataFrame functions only.

Texts are equal when they are identical after each run of white space (space, TAB to CR) became one
space. Rows are grouped by the 128-bit MD5 of that text together with the text itself, so that the
aggregation compares bytes inside every hash group: two texts with one hash stay two groups. Copies are
folded on the map side before the shuffle. Membership is then found by a join of thin rows (id and two
digests) with one row per group, whose hot keys Spark's adaptive skew join splits.

Defined results: a null text counts as empty, and all empty texts are one group; a null id sorts after
every other id and is kept only if its whole group has no id (then keep_id is null); repeated rows are
copies of each other and each gets its row (kept is true for every row that carries the kept id); an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, chosen_rows, text_of


def normalized(text: str = "text"):
    return F.regexp_replace(text_of(text), SEPARATORS, " ")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct normalised text: h128, sha (binary), keep_id, group_size."""
    whole = docs.select(F.col(key).alias("id"), normalized(text).alias("norm"))
    whole = whole.select("id", "norm", F.unhex(F.md5("norm")).alias("h128"))
    groups = whole.groupBy("h128", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("h128", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    thin = docs.select(F.col(key).alias("doc_id"), normalized(text).alias("norm")).select(
        "doc_id", F.unhex(F.md5("norm")).alias("h128"), F.unhex(F.sha2("norm", 256)).alias("sha")
    )
    found = thin.join(exact_groups(docs, key, text), ["h128", "sha"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies: one row of each group, with the group's least id; of several such rows, the least by its columns in order."""
    kept = exact_groups(docs, key, text).select(F.col("keep_id").alias("id"), F.hex("sha").alias("digest"))
    return chosen_rows(docs, F.col(key), F.upper(F.sha2(normalized(text), 256)), kept)
