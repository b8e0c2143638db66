"""Rates, intervals, thresholds, costs and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pieces


def rate_cube(rows: DataFrame, hit: str, *by: str) -> DataFrame:
    """n, hits and rate for every combination of the columns."""
    h = F.col(hit)
    return rows.cube(*by).agg(F.count("*").alias("n"), F.count_if(h).alias("hits"), F.round(F.avg(h.cast("double")), 6).alias("rate"))


def rate_interval(rows: DataFrame, hit: str, by: str, z: float = 1.96) -> DataFrame:
    """Rate by group with its normal interval."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("double")).alias("p"))
    half = z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return g.select(by, "n", F.round("p", 6).alias("rate"), F.round(F.greatest(F.lit(0.0), F.col("p") - half), 6).alias("lo"), F.round(F.least(F.lit(1.0), F.col("p") + half), 6).alias("hi"))


def alarm_value(rows: DataFrame, hit: str, positive: Column, prevalences: tuple[float, ...]) -> DataFrame:
    """Share of alarms that are right, at each prevalence; null if there is no alarm."""
    h = F.col(hit).cast("double")
    s = rows.agg(F.avg(F.when(positive, h)).alias("recall"), F.avg(F.when(~positive, h)).alias("fpr"))
    p = F.col("prevalence")
    s = s.withColumn("prevalence", F.explode(F.array(*map(F.lit, prevalences))))
    total = p * F.col("recall") + (1 - p) * F.col("fpr")
    return s.select("prevalence", F.round(F.when(total != 0, p * F.col("recall") / total), 6).alias("ppv"))


def threshold_at_budget(scores: DataFrame, budgets: tuple[float, ...], score: str = "score", y: str = "y") -> DataFrame:
    """The lowest threshold whose false-alarm rate stays within each budget, and the recall there. Distinct scores alone are sorted, after aggregation."""
    t = scores.groupBy(score).agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))
    w, everything = Window.orderBy(F.col(score).desc()), Window.partitionBy()
    share = lambda c: F.sum(c).over(w) / F.sum(c).over(everything)
    c = t.select(score, share("n0").alias("fpr"), share("n1").alias("recall")).withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("fpr <= budget")
    return c.groupBy("budget").agg(F.round(F.min(score), 6).alias("threshold"), F.round(F.max("fpr"), 6).alias("fpr"), F.round(F.max("recall"), 6).alias("recall"))


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Element floor(n p) of the sorted values, without interpolation. Values are counted first, so that only distinct ones are sorted."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    w = Window.orderBy(value)
    c = counts.select(value, F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    c = c.withColumn("p", F.explode(F.array(*map(F.lit, shares)))).where(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.col("p"))))
    return c.groupBy("p").agg(F.min(value).alias(value))


def cost_model(rows: DataFrame, size: str, ms: str) -> DataFrame:
    """Least squares of cost on size; slope 0 and the mean where sizes do not vary."""
    slope, mean = F.regr_slope(ms, size), F.avg(ms)
    return rows.agg(F.round(F.coalesce(slope, F.lit(0.0)), 6).alias("slope"), F.round(F.coalesce(F.regr_intercept(ms, size), mean), 6).alias("intercept"), F.count("*").alias("n"))


def bootstrap_slope(rows: DataFrame, size: str, ms: str, resamples: int = 2000, seed: int = 20260801, key: str | None = None) -> DataFrame:
    """(lo, hi) of the middle 95% of slopes over Poisson resamples; null under eight rows. Each row adds to all resamples where it stands; only sums by resample are shuffled. Weights hang on the row's key, or without one on its values, so that rows of equal values share theirs, and never on how rows are dealt."""
    w = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda r: F.pmod(F.xxhash64(F.col("_id"), r, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    df = rows.select(F.xxhash64(*([key] if key else [size, ms])).alias("_id"), F.col(size).cast("double").alias("x"), F.col(ms).cast("double").alias("y"))
    df = df.select("x", "y", F.posexplode(w).alias("r", "u"))
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    df = df.withColumn("w", weight).where("w > 0")
    g = df.groupBy("r").agg(F.sum("w").alias("n"), F.sum(F.expr("w * x")).alias("sx"), F.sum(F.expr("w * y")).alias("sy"), F.sum(F.expr("w * x * y")).alias("sxy"), F.sum(F.expr("w * x * x")).alias("sxx"))
    slope = F.expr("(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)")
    out = g.select(slope.alias("s"), "n").agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"), F.avg("n").alias("n"))
    few = F.col("n") < 8
    return out.select(*[F.when(~few, F.col(c)).alias(c) for c in ("lo", "hi")])


def numbered(rows: DataFrame, *order: str, number: str = "rn") -> DataFrame:
    """The rows in order, numbered from 0, over a range partitioning: rows of a partition are numbered by themselves, and counts of partitions make where each begins. The rows are read twice, so they must come the same both times, as from files. Ties fall by chance unless the order is of all columns that matter."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    # The number within a partition, and the partition, are in the two halves of this id.
    dealt = dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", part)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return dealt.join(first, "_part").withColumn(number, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_id")


def systematic(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Every (n / k)-th row in order, k at most."""
    step = max(1, rows.count() // k)
    return numbered(rows, order, number="_rn").where((F.col("_rn") % step == 0) & (F.col("_rn") < step * k)).drop("_rn")


def held_out(key: str) -> Column:
    """By the parity of the id's MD5."""
    return F.substring(F.md5(F.col(key).cast("string").cast("binary")), 32, 1).isin(*"13579bdf")


def shingle_pairs(rows: DataFrame, key: str, text: str, k: int = 5, least: float = 0.3) -> DataFrame:
    """(a, b, jaccard) of rows whose distinct k-word shingles overlap by more than `least`, over all shingles.

    In the order of rarity, two such rows share one of their first n - floor(least n) shingles, so only these are paired; a shingle that many rows have comes last and pairs few. Candidates are compared in full.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    some = rows.select(F.col(key).alias("k"), words.alias("w")).where(F.size("w") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))
    sets = some.select("k", F.array_distinct(grams).alias("s"))
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("g"))
    rare = each.join(each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")
    # Shingles of one row alone come first of all, and pair nothing: they only count.
    alone = F.col("n") - F.count("*").over(Window.partitionBy("k"))
    nth = F.row_number().over(Window.partitionBy("k").orderBy("df", "g")) + alone
    head = rare.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.floor(F.col("n") * least)).select("k", "g")
    p = head.select(F.col("k").alias("a"), "g").join(head.select(F.col("k").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    p = p.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    c = F.size(F.array_intersect("x", "y"))
    j = c / (F.size("x") + F.size("y") - c)
    return p.where(j > least).select("a", "b", F.round(j, 6).alias("jaccard"))


def without_near(rows: DataFrame, key: str, text: str, k: int = 5, least: float = 0.3) -> DataFrame:
    """The rows but those of which an earlier one, by key, is a near-duplicate."""
    later = shingle_pairs(rows, key, text, k, least).select(F.col("b").alias(key)).distinct()
    return rows.join(later, key, "left_anti").select(*rows.columns)


def overlap(rows: DataFrame) -> DataFrame:
    """iou, covered and precision of (lo, hi) against (inj_lo, inj_hi)."""
    i = F.greatest(F.lit(0), F.least("hi", "inj_hi") - F.greatest("lo", "inj_lo"))
    return rows.withColumn("iou", F.round(i / (F.greatest("hi", "inj_hi") - F.least("lo", "inj_lo")), 6)).withColumn("covered", F.round(i / (F.col("inj_hi") - F.col("inj_lo")), 6)).withColumn("precision", F.round(i / (F.col("hi") - F.col("lo")), 6))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


#: Fixed value: a common run shorter than this is language, not payload.
RUN = 25


#: Runs that are each searched in the text; of more, the text's are looked up among them.
SEARCHED = 256


def _shared(a: str, b: str, n: int) -> bool:
    some = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(x in b for x in some) if len(some) <= SEARCHED else any(b[i : i + n] in some for i in range(len(b) - n + 1))


def longest_common(a: str, b: str, least: int = 1) -> int:
    """Length of the longest run that both hold, 0 if it is shorter than least: a binary search over lengths, runs of a length compared as a set."""
    lo, hi = least, min(len(a), len(b))
    if hi < lo or not _shared(a, b, lo):
        return 0
    while lo < hi:
        n = (lo + hi + 1) // 2
        if _shared(a, b, n):
            lo = n
        else:
            hi = n - 1
    return lo


def survival(rows: DataFrame, payload: str, text: str, name: str = "survival") -> DataFrame:
    """The rows with the share of the payload that the text still holds: 1 if it is there whole, blanks squeezed, else that of the longest common run of RUN characters at least. An empty or null payload, or a null text, gives 0. Only what is not whole reaches Python."""
    return survivals(rows, payload, {name: text}, rows.columns)


def survivals(rows: DataFrame, payload: str, texts: dict[str, str], columns: list[str]) -> DataFrame:
    """columns of the rows, with survival() of each text under its name. All shares are made in one Arrow stage, which holds a piece of texts at a time; a text that holds the payload whole is not sent."""
    one = lambda c: F.trim(squeezed(F.coalesce(F.col(c), F.lit(""))))
    df = rows.select(*columns, one(payload).alias("_p"), *[one(t).alias(f"_t{i}") for i, t in enumerate(texts.values())])
    for i, _ in enumerate(texts):
        whole = F.when(F.col("_p") == "", 0.0).when(F.contains(f"_t{i}", "_p"), 1.0)
        df = df.withColumn(f"_k{i}", whole).withColumn(f"_t{i}", F.when(F.col(f"_k{i}").isNull(), F.col(f"_t{i}")))
    first, n = len(columns), len(texts)
    df = df.select(*columns, "_p", *[f"_t{i}" for i in range(n)], *[f"_k{i}" for i in range(n)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:first])

    def share(known: float | None, p: str, t: str) -> float:
        if known is not None:
            return known
        return longest_common(p, t, RUN) / len(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in range(first, first + 1 + n):
            batches = pieces(batches, c)
        for b in batches:
            ps = b.column(first)
            made = [[share(k.as_py(), p.as_py(), t.as_py()) for k, p, t in zip(b.column(first + 1 + n + i), ps, b.column(first + 1 + i), strict=True)] for i in range(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:first], *(pa.array(m, pa.float64()) for m in made)], names=[*b.schema.names[:first], *texts])

    return df.mapInArrow(run, ", ".join(filter(None, [fields, *[f"`{x}` double" for x in texts]])))


def damage(rows: DataFrame) -> DataFrame:
    """One row of counts: intact before and after (over 0.99 of the payload), gone after (under 0.1), clean documents dropped (under 0.01 of their length left) and trimmed (under 0.999). rows: before and after, survivals of documents with a payload, null for others; kept, of clean documents, null for others. They are read once."""
    return rows.agg(
        *[F.count("before").alias("payloads"), F.count_if(F.col("before") > 0.99).alias("intact_before")],
        *[F.count_if(F.col("after") > 0.99).alias("intact_after"), F.count_if(F.col("after") < 0.10).alias("gone_after")],
        *[F.count("kept").alias("clean"), F.count_if(F.col("kept") < 0.01).alias("clean_dropped"), F.count_if((F.col("kept") >= 0.01) & (F.col("kept") < 0.999)).alias("clean_trimmed")],
    )


def mismatches(one: DataFrame, two: DataFrame) -> DataFrame:
    """(only_one, only_two, total): rows of either table that the other lacks, repeated ones by number."""
    columns = one.columns
    x, y = one.select(columns), two.select(columns)
    left, right = x.exceptAll(y).agg(F.count("*").alias("only_one")), y.exceptAll(x).agg(F.count("*").alias("only_two"))
    return left.join(right).select("only_one", "only_two", (F.col("only_one") + F.col("only_two")).alias("total"))


def paired(rows: DataFrame, before: str, after: str, by: str) -> DataFrame:
    """(by, gains, losses, net): how many rows each group won and lost from one detector to another."""
    g = rows.groupBy(by).agg(F.count_if(~F.col(before) & F.col(after)).alias("gains"), F.count_if(F.col(before) & ~F.col(after)).alias("losses"))
    return g.withColumn("net", F.col("gains") - F.col("losses"))


def cell_coverage(rows: DataFrame, hit: str, *by: str, least: float = 0.5) -> DataFrame:
    """(cells, covered, share): how many groups have a rate of `least` or more."""
    cells = rows.groupBy(*by).agg(F.avg(F.col(hit).cast("double")).alias("rate"))
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("rate") >= least).alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("cells"), 6))


def timings(run, texts: list[tuple[object, str]], repeats: int = 3) -> list[tuple[object, int, float]]:
    """(key, size, median ms) of a function over some texts, on the driver."""
    import time

    out = []
    for key, text in texts:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            run(text)
            took.append(1000 * (time.perf_counter() - began))
        out.append((key, len(text), float(np.median(took))))
    return out
