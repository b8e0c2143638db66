"""Connected components over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped

#: So many links at most (16 bytes each) are closed by one task; more by rounds of joins.
ONE_TASK = 1 << 20


def closed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each reaches)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # A root takes the least label of its members' neighbours, then all follow their roots.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, closed(*map(np.concatenate, zip(*got, strict=True))))), names=["node", "component"])

    return links.coalesce(1).transform(mapped, run, "node long, component long")


def _with_min(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least v of its u. The least is pre-aggregated, so a hot u costs one row per task; Spark splits the join."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of a link, component the least node reachable.

    Few links are closed by one task of an executor. Else it alternates large-star and small-star steps: links turn into stars in a logarithmic number of rounds, and never grow in number. No links: no rows. Null or self links are ignored.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, before = cut(e), None
    if e.limit(one_task + 1).count() <= one_task:
        return cut(_in_one_task(e))
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_min(large)
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(small.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
