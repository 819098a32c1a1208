"""A training corpus from raw documents, in five stages.

quality -> line dedup -> near duplicates -> decontamination -> mixing. Each stage works on all that the
one before kept; its result is written as Parquet to the shared folder and read again, so a lost
executor costs one stage at most. Null ids, null and empty texts and empty tables pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, jaccardjoin, linededup, mixing, quality
from meterlake.llm.common import empty, free, stored, table

#: Near duplicates: word shingles and percent of similarity.
NEAR_WORDS, NEAR_NUM = 5, 80


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def once(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of long passages on fewer lines, are cut; documents that were nothing else go."""
    cut = linededup.dedup_lines(docs, words=linededup.LONG_WORDS, n_lines=free(docs, "n_lines"), n_removed=free(docs, "n_removed"))
    lines, removed = cut.columns[-2:]
    return _measured(cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines))).drop(lines, removed))


def unlike(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; null ids stay.

    Where ids repeat, each row is a document of its own: one row of a group stays, the smallest by id, then by its text's hash.
    """
    named = docs.where("doc_id is not null")
    if empty(named.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")):
        found = jaccardjoin.join(named.select(F.col("doc_id").cast("long").alias("id"), "text"), NEAR_WORDS, NEAR_NUM)
        copies = stored(found.where("component_id < id").select(F.col("id").alias("doc_id")).distinct(), "pipeline-copies")
        return docs.join(copies, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    row = free(docs, "row")
    rows = jaccardjoin.numbered(named, row)
    found = jaccardjoin.join_once(rows.select(F.col(row).alias("id"), "text"), NEAR_WORDS, NEAR_NUM).select(F.col("id").alias("k"), F.col("component_id").alias("g"))
    order = F.struct(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col(row))
    first = stored(rows.join(found, F.col(row) == F.col("k")).groupBy("g").agg(F.min(order).alias("o")).select(F.col(f"o.{row}").alias("k")), "pipeline-first")
    kept = rows.join(first, F.col(row) == F.col("k"), "left_semi").drop(row)
    return kept.unionByName(docs.where("doc_id is null"))


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; lesser hits on benchmark items are cut from the text."""
    return _measured(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the copies that bring its source to its weight."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good),
    ("line dedup", once),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", clean),
    ("mixing sources", mixed),
]

#: No SQL: the classifier and the exponent are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
