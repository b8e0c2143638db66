"""Mixing sources to target weights with a low-discrepancy schedule.

Sources share the whole number of words by weight, none over three times its own. Slot t of the schedule goes to the source whose part of the cumulative targets holds the t-th golden-ratio point; the slots of a source, ranked, take equal blocks of words from the source's shuffled documents, over and over, at most three times. The schedule decides: a source takes as many blocks as points fall to it, which differs from its target by a few blocks at any size (see deviation()), and the mix comes in the order of its slots.

Words before a row in its shuffled source are prefix sums over a range partitioning by source, digest and row, so that neither a hot source nor a hot digest is one task.

Edge cases: a null text has no words; documents without words are never taken. Very long texts span many blocks. Null is a source of its own, last in order. Repeated rows are separate documents, and of equal ones it is open which is taken first. Without any word all targets are 0. An empty table gives no rows. Reruns agree: the shuffle is by a digest of doc_id and text. Further columns are ignored or, in mix(), kept, whatever their names. One row per source passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, cut, fresh, mapped, shared_folder, table

REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Words of a slot, and slots that one row of the generator makes.
BLOCK, CHUNK = 64, 1 << 16
GOLDEN = (math.sqrt(5) - 1) / 2
#: At most so many sources, or partial sums, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def deviation(slots: int) -> float:
    """Slots by which a source's count among the first so many golden-ratio points can differ from its part: twice the bound on the points' discrepancy (Kuipers and Niederreiter, theorem 3.4), as a part has two edges. In practice it is under three."""
    return 2 * (3 + (1 / math.log((1 + math.sqrt(5)) / 2) + 1 / math.log(2)) * math.log(max(1, slots)))


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", row: str | None = None) -> DataFrame:
    """Per row: row (a number, that of column `row` if given), doc_id, source, size in words, and the digest that orders the shuffle."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    shuffle = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), shuffle.alias("shuffle"))


def _small_or_whole(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, number, weight, target) from (source, source_size).

    Weighted shares with caps are water-filling: in the order of cap over weight, a source is capped as long as its share of what is left exceeds its cap; the rest share what is then left.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("rank", F.row_number().over(order))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("level", left / weight_left)
    w = w.withColumn("first", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("rank"))).over(everything))
    w = w.withColumn("water", F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("rank") < F.col("first"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return w.select("source", "source_size", "number", "weight", target.alias("target"))


def slots(spark, quotas: list[int], block: int = BLOCK) -> DataFrame:
    """(number, rank, slot): the schedule's slots of each source, ranked. quotas: target words by source number.

    Counts by chunk, summed up over chunks, turn ranks within a chunk into ranks of the source, so no task walks a whole source.
    """
    total = sum(quotas)
    n = -(-total // block)
    edges = np.cumsum(np.array(quotas or [0], float)) / max(1, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column("id").to_pylist():
                t = np.arange(chunk * CHUNK, min(n, (chunk + 1) * CHUNK))
                x = (t + 0.5) * GOLDEN
                s = np.minimum(np.searchsorted(edges, x - np.floor(x), side="right"), len(edges) - 1)
                order = np.argsort(s, kind="stable")
                first = np.searchsorted(s[order], s[order])
                local = np.empty(len(t), np.int64)
                local[order] = np.arange(len(t)) - first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), chunk)), pa.array(s.astype(np.int64)), pa.array(local), pa.array(t)], names=["chunk", "number", "local", "slot"])

    dealt = spark.range(-(-n // CHUNK)).transform(mapped, run, "chunk long, number long, local long, slot long")
    counts = dealt.groupBy("chunk", "number").agg(F.count("*").alias("here"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("chunk", "number", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before")))
    # The planner takes the generator's rows for few, but chunks and sources are.
    return dealt.join(_small_or_whole(counts), ["chunk", "number"]).select("number", (F.col("before") + F.col("local")).alias("rank"), "slot")


def positions(docs: DataFrame) -> DataFrame:
    """(row, number, size, at), at the words before the row in its shuffled source, from (row, number, size, shuffle); rows without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, 0
        for b in batches:
            n, size = b.column("number").to_numpy(), b.column("size").to_numpy()
            if not len(n):
                continue
            sums = np.cumsum(size)
            first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
            base = np.repeat(np.where(first > 0, sums[first - 1], 0), np.diff(np.concatenate([first, [len(n)]])))
            within = sums - size - base + np.where(n == number, total, 0)
            number, total = n[-1], within[-1] + size[-1]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("number"), b.column("size"), pa.array(within)], names=["row", "number", "size", "within"])

    order = ["number", "shuffle", "row"]
    dealt = docs.where("size > 0").select("row", "number", "size", "shuffle").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "number", "size")
    summed = cut(dealt.transform(mapped, run, "row long, number long, size long, within long").withColumn("part", F.spark_partition_id()))
    # One row for each partition and source in it, so about as many as partitions.
    sums = summed.groupBy("part", "number").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.select("part", "number", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")))
    return summed.join(_small_or_whole(sums), ["part", "number"]).select("row", "number", "size", (F.col("base") + F.col("within")).alias("at"))


def pieces(docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, number, rank, epoch, start, words): what each block takes from each row. docs: sized(); sources: (source, number, source_size, quota), in which quota is what the source's blocks can hold."""
    few = _small_or_whole(sources.select(F.col("source").alias("of"), "number"))
    numbered = docs.where("size > 0").join(few, F.col("source").eqNullSafe(F.col("of"))).select("row", "number", "size", "shuffle")
    d = positions(numbered).join(_small_or_whole(sources.select("number", "source_size", "quota")), "number")
    last = F.ceil(F.col("quota") / F.col("source_size")).cast("int") - 1
    d = d.where("quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    d = d.withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "quota")).where("lo < hi")
    d = d.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    start = F.greatest("lo", F.col("rank") * block)
    return d.select("row", "number", "rank", "epoch", (start - F.col("lo")).alias("start"), (F.least("hi", (F.col("rank") + 1) * block) - start).alias("words"))


def schedule(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(plan, sources) for docs from sized(), checkpointed. plan: (slot, row, epoch, start, words) puts in slot `slot` the words from `start` of that row; sources: targets() with number. One row per source passes through the driver."""
    spark = docs.sparkSession
    sources = cut(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    dealt = slots(spark, [r.quota for r in sources.orderBy("number").select(F.floor(F.col("target") + 0.5).alias("quota")).collect()], block)
    # The blocks that the points gave to a source are its quota; over three times its size they stay empty.
    have = dealt.groupBy("number").agg((F.count("*") * block).alias("have"))
    held = cut(sources.join(have, "number", "left").select("source", "number", "source_size", F.least(F.coalesce("have", F.lit(0)), F.col("source_size") * repeats).alias("quota")))
    took = pieces(docs, held, block)
    return took.join(dealt.hint("merge"), ["number", "rank"]).select("slot", "row", "epoch", "start", "words"), sources


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """The rows written to the shared folder once with a number, and read from there: a row keeps its number whatever is lost or run again."""
    at = shared_folder(docs.sparkSession, "mix")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as its slots: (slot, doc_id, source, epoch, start, words, text), the pieces of each slot with their words, single spaces between. Sort by slot, then doc_id and start, to read it in order."""
    row = fresh("row", docs.columns)
    numbered = _numbered(docs.select(F.col(key), F.col(text), F.col(source)), row)
    plan, _ = schedule(cut(sized(numbered, text, key, source, row)), block)
    named = numbered.select(F.col(row).alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_extract_all(F.col(text), F.lit(WORD_CLASS), F.lit(0)).alias("all"))
    return plan.join(named, "row").select("slot", "doc_id", "source", "epoch", "start", "words", F.array_join(F.slice("all", (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mixed documents in the order of the first slot that takes of them: each row once for every pass that takes of it, its text cut where its source's blocks end. Columns as before."""
    row, take, slot = (fresh(c, docs.columns) for c in ("row", "take", "slot"))
    numbered = _numbered(docs, row)
    plan, _ = schedule(cut(sized(numbered, text, key, source, row)), block)
    takes = plan.groupBy(F.col("row").alias(row), "epoch").agg(F.sum("words").alias(take), F.min("slot").alias(slot)).select(row, take, slot)
    # A whole text stays as it is; of a part, the words stand with single spaces.
    words = F.regexp_count(F.col(text), F.lit(WORD_CLASS))
    cut_text = F.when(F.col(take) >= words, F.col(text)).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD_CLASS), F.lit(0)), 1, F.col(take).cast("int")), " "))
    mixed = numbered.join(takes, row).withColumn(text, cut_text)
    return mixed.repartitionByRange(slot, row).sortWithinPartitions(slot, row).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = cut(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    plan, sources = schedule(docs)
    taken = plan.groupBy("row").agg(F.sum("words").alias("taken"))
    few = _small_or_whole(sources.select(F.col("source").alias("of"), "source_size", "target"))
    out = docs.join(taken, "row", "left").join(few, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS shuffle
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CAST(number % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM s),
r AS (
  SELECT *, row_number() OVER o AS rank,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, number)),
f AS (SELECT min(rank) AS first FROM r WHERE cap >= level * weight),
t AS (
  SELECT source, number, source_size, CASE WHEN rank < first THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM r WHERE rank = first) * weight END AS target
  FROM r, f),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
e AS (SELECT number, CAST(sum(goal) OVER (ORDER BY number) AS DOUBLE) / (SELECT CAST(greatest(1, sum(goal)) AS DOUBLE) FROM g) AS edge FROM g),
i AS (SELECT number, coalesce(lag(edge) OVER (ORDER BY number), 0) AS lo, edge AS hi FROM e),
x AS (SELECT unnest(range(CAST(ceil((SELECT sum(goal) FROM g) / {BLOCK}.0) AS BIGINT))) AS slot),
y AS (SELECT slot, (slot + CAST(0.5 AS DOUBLE)) * CAST('{GOLDEN!r}' AS DOUBLE) AS p FROM x),
h AS (SELECT i.number, count(*) * {BLOCK} AS have FROM y JOIN i ON y.p - floor(y.p) >= i.lo AND y.p - floor(y.p) < i.hi GROUP BY i.number),
q AS (SELECT g.*, least(coalesce(have, 0), source_size * 3) AS quota FROM g LEFT JOIN h USING (number)),
p AS (
  SELECT d.*, q.source_size, q.target, q.quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, quota - pos)) + greatest(0, least(size, quota - pos - source_size)) + greatest(0, least(size, quota - pos - 2 * source_size)) AS BIGINT) AS taken
FROM p
"""
