"""From raw documents to packed windows: quality, near-duplicates, secrets, mixing, packing.

Every stage takes the columns of documents and further ones, of any names, and returns them, but for the last. Null texts and ids, empty and very long texts, repeated rows, ties and empty tables are as the stage's operator states; what the stage makes of them is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsift.llm import mixing, neardup, packing, quality, secrets
from tarnsift.llm.common import fresh, remove, scratch, shared_dir, table

#: At most so many ids to remove are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under the cutoff, by a classifier trained on the labelled ones. Without labels nothing is rejected; a null text is scored like an empty one; equal texts share a fate, and a score equal to the cutoff stays."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five-word shingles, similarity of 0.8 or more). Of rows that repeat an id, one stays, the first by digest of the text, then text and other columns; rows without an id stay, and so do null and empty texts, which are copies of nothing."""
    found = neardup.cluster(docs.select("doc_id", "text"), 5, (80, 100))
    gone = neardup.cut(found.where("not kept").select("doc_id").distinct())
    repeated = neardup.cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    stays = docs.join(_marked(gone), "doc_id", "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return stays
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    nth = fresh("nth", docs.columns)
    one = stays.join(_marked(repeated), "doc_id", "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return stays.join(_marked(repeated), "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def _marked(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; no document goes, and a null text stays null."""
    return _with_length(secrets.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, over again up to three times where it is under it, in the order of the schedule. Documents without words go, null texts too."""
    return _with_length(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, one row per piece, with the ids. A null text counts as empty."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", neardup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Not in SQL: boosted trees, MinHash, Markov models and byte-pair encoding. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next. What a stage has written meanwhile, and its input, go once its result is written; the last folder stays, as the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stage(spark, docs, sf_dir)
            at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
