"""Embedding near-duplicates by an epsilon grid order join.

Vectors with cosine of at least c have unit vectors within epsilon = sqrt(2 - 2c). Unit vectors are sorted by their grid cells on leading principal dimensions, cut into blocks, and each block gets a bounding box on those dimensions. Pairs of sequence intervals are halved again and again, from the whole table down to pairs of blocks, and a pair whose boxes lie further apart than epsilon is dropped with all below it: an orthonormal projection never lengthens a distance, so no link is lost, however the dimensions were fitted. The pairs of blocks left are compared in full, in double precision: a task holds some neighbouring blocks, and the partners of these pass by one after another, so a block is sent once to each group of its partners and not once for each pair.

Equal vectors are one class from the start; only its first row is sorted and compared, and it counts for as many links as it has rows. A pair of blocks returns link counts per vector and a spanning forest of its links, never all links.

Edge cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and is kept, as does a row with null id, whose component is null. Vectors of different length never link. Rows that repeat an id are one node of the graph, but for those whose vector can't link; each of their vectors counts as a link of the others it reaches. An empty table gives no rows. Labels and further columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, table
from .graph import components

COSINE = 0.9
#: Leading dimensions, vectors they are fitted on at most, and vectors and bytes of a block.
DIMENSIONS, SAMPLE, BLOCK, BLOCK_BYTES = 6, 4096, 2048, 1 << 20
#: Neighbouring blocks that a task holds while their partners pass by, and pairs of blocks of a task.
TILE, TILE_PAIRS = 8, 96
#: Children of an interval at each level of the recursion.
FAN = 16


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by the largest magnitude, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Mean and leading principal directions as rows; signs are fixed."""
    mean = sample.mean(axis=0)
    _, _, v = np.linalg.svd(sample - mean, full_matrices=False)
    v = v[:dimensions]
    v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1, 1)[:, None]
    return np.vstack([mean, v])


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def prepared(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per row: row (a number), id, v (array<float> if given so, else array<double>; null where it can't link), d (its length), digest (128 bits of v)."""
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    x = F.col(vector) if narrow else F.col(vector).cast("array<double>")
    # A null component makes the first test null, a NaN or infinite one fails it.
    sound = F.forall(x, lambda c: F.abs(c) < float("inf")) & F.exists(x, lambda c: c != 0)
    df = vectors.select(F.col(key).alias("id"), F.when(F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull(), x).alias("v"))
    digest = F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary")))
    return cut(df.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("v")).withColumn("digest", digest))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to compare: row, v, d, copies; classes: digest, row, least, copies). Digests are counted before anything is joined, so a hot vector costs one row per task."""
    made = cut(rows.where("v is not null").groupBy("digest").agg(F.min("row").alias("row"), F.min("id").alias("least"), F.count("*").alias("copies")))
    return rows.join(made.select("row", "copies"), "row").select("row", "v", "d", "copies"), made


def blocks(rows: DataFrame, epsilon: float, block: int = BLOCK, dimensions: int = DIMENSIONS) -> DataFrame:
    """Packed blocks in grid order: (block, d, rows array<long>, copies array<long>, data binary of floats or doubles, as given, lo and hi of the box). A block holds vectors of one length."""
    lengths = {r.d: r.n for r in rows.groupBy("d").agg(F.count("*").alias("n")).where("d > 0").collect()}
    kind = rows.schema["v"].dataType.simpleString()
    most = max(64, SAMPLE // max(1, len(lengths)))
    share = F.create_map(*[F.lit(x) for d, n in sorted(lengths.items()) for x in (d, int(min(1.0, most / n) * (1 << 30)))]) if lengths else F.lit(None).cast("map<int,int>")
    # The share of hashes makes about `most` rows of each length; all lengths are read in one job.
    picked = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.element_at(share, F.col("d"))).select("row", "d", "v").toPandas().sort_values("row") if lengths else None
    bases = {d: principal(unit(np.stack(x)) if len(x := picked["v"][picked["d"] == d].to_list()) else np.eye(1, d), dimensions) for d in lengths}
    of = lambda d: max(1, min(block, BLOCK_BYTES // (8 * d)))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("d").to_numpy()
            cells = np.zeros((len(d), dimensions), np.int64)
            for n in np.unique(d).tolist():
                pick = np.flatnonzero(d == n)
                base = bases[n]
                p = (unit(_matrix(b.column("v").take(pa.array(pick)), n)) - base[0]) @ base[1:].T
                cells[pick, : p.shape[1]] = np.floor(p / epsilon * 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "copies", "d", "v")), *(pa.array(cells[:, i]) for i in range(dimensions))], names=["row", "copies", "d", "v", *(f"c{i}" for i in range(dimensions))])

    cells = [f"c{i}" for i in range(dimensions)]
    sized = rows.transform(mapped, order, f"row long, copies long, d int, v {kind}, " + ", ".join(f"{c} long" for c in cells))
    parts = max(1, sum(-(-n // of(d)) for d, n in lengths.items()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            d = t.column("d").to_numpy()
            for n in np.unique(d).tolist():
                s = t.filter(pa.array(d == n)).combine_chunks()
                for at in range(0, s.num_rows, of(n)):
                    part = s.slice(at, of(n)).combine_chunks()
                    x = _matrix(part.column("v").chunk(0), n)
                    base = bases[n]
                    p = np.zeros((len(x), dimensions))
                    q = (unit(x) - base[0]) @ base[1:].T
                    p[:, : q.shape[1]] = q
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n], pa.int32()), pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("copies").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64()))],
                        names=["d", "rows", "copies", "data", "lo", "hi"],
                    )

        # Batches follow the grid order; a block is cut as soon as it is full, so a task holds one block and one batch.
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= block:
                t = pa.Table.from_batches(held)
                whole = size // block * block
                yield from out(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                size -= whole
        if size:
            yield from out(pa.Table.from_batches(held))

    ranged = sized.repartitionByRange(parts, "d", *cells, "row").sortWithinPartitions("d", *cells, "row")
    packed = ranged.transform(mapped, pack, "d int, rows array<long>, copies array<long>, data binary, lo array<double>, hi array<double>")
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def near_blocks(boxes: DataFrame, epsilon: float, fan: int = FAN) -> DataFrame:
    """(tile, a, b) of blocks that may hold links, each pair once, from (block, d, lo, hi); tile numbers runs of neighbouring a.

    Intervals of the sequence are numbered by position over fan to the level. From the whole sequence down, each pair of intervals whose boxes come within epsilon is replaced by the pairs of their children that do.
    """
    n = boxes.count()
    levels = 0
    while fan**levels < n:
        levels += 1
    from pyspark.sql import Window

    # One row per block; the running number over them is taken by partition of the id first, so no task sees all blocks.
    part = F.shiftright("block", 33)
    counts = boxes.groupBy(part.alias("part")).count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = boxes.withColumn("part", part).join(before, "part").withColumn("at", F.col("before") + F.col("block").bitwiseAND(F.lit((1 << 33) - 1))).select("block", "at", "d", "lo", "hi")
    at = cut(at)
    dims = at.select(F.size("lo")).first()
    dims = dims[0] if dims else 0

    def interval(level: int) -> DataFrame:
        g = at.withColumn("i", F.floor(F.col("at") / fan**level).cast("long")).groupBy("i")
        return g.agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.array(*[F.min(F.col("lo")[k]) for k in range(dims)]).alias("lo"), F.array(*[F.max(F.col("hi")[k]) for k in range(dims)]).alias("hi"))

    pairs = at.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(1)
    for level in range(levels - 1, -1, -1):
        child = F.sequence(F.lit(0), F.lit(fan - 1))
        pairs = pairs.withColumn("x", F.explode(child)).withColumn("y", F.explode(child)).select((F.col("a") * fan + F.col("x")).alias("a"), (F.col("b") * fan + F.col("y")).alias("b")).where("a <= b")
        box = interval(level)
        one, two = (box.select(F.col("i").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("d0", "d1", "lo", "hi"))) for c in "ab")
        gap = [F.greatest(F.lit(0.0), F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k]) for k in range(dims)]
        distance = sum((g * g for g in gap), F.lit(0.0))
        near = (distance <= epsilon * epsilon * (1 + 1e-9) + 1e-12) & (F.col("d0_a") <= F.col("d1_b")) & (F.col("d0_b") <= F.col("d1_a"))
        pairs = cut(pairs.join(one, "a").join(two, "b").where(near).select("a", "b"))
    names = at.select("at", "block")
    out = pairs.join(names.select(F.col("at").alias("a"), F.col("block").alias("block_a")), "a").join(names.select(F.col("at").alias("b"), F.col("block").alias("block_b")), "b")
    return out.select(F.floor(F.col("a") / TILE).alias("tile"), F.col("block_a").alias("a"), F.col("block_b").alias("b"))


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int]]:
    parent = list(range(size))
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _thin(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of many links, those between labels that a few rounds of least-neighbour labelling leave different, and the ones that gave the labels: enough for the components."""
    label = np.arange(size)
    kept_i, kept_j = [], []
    for _ in range(3):
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            break
        least = label.copy()
        by = np.full(size, -1)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((label[b], label[a]))
        first = np.flatnonzero(np.concatenate([[True], np.diff(label[a][order]) != 0]))
        root, edge = label[a][order][first], order[first]
        down = label[b[edge]] < root
        root, edge = root[down], edge[down]
        by[root], least[root] = edge, label[b[edge]]
        kept_i.append(a[edge])
        kept_j.append(b[edge])
        while True:
            up = least[least]
            if (up == least).all():
                break
            least = up
        label = least[label]
    apart = label[i] != label[j]
    kept_i.append(i[apart])
    kept_j.append(j[apart])
    return np.concatenate(kept_i), np.concatenate(kept_j)


def compare(pairs: DataFrame, packed: DataFrame, cosine: float = COSINE, narrow: bool = False) -> DataFrame:
    """From (tile, a, b) of near_blocks(): rows (row, n, null) with numbers of links, and rows (row, null, other) with a spanning forest of them."""

    def compared(held: tuple, passing: tuple) -> Iterator[pa.RecordBatch]:
        (a, rows_a, copies_a, x), (b, rows_b, copies_b, y) = held, passing
        if x.shape[1] != y.shape[1]:
            return
        same = a == b
        count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        li, lj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(x), 512):
            near = x[at : at + 512] @ y.T >= cosine
            if same:
                near[np.arange(near.shape[0]), at + np.arange(near.shape[0])] = False
            if near.any():
                i, j = np.nonzero(near)
                count_x[at : at + 512] += near @ copies_b
                count_y += copies_a[at : at + 512] @ near
                i, j = _thin(i + at, j + (0 if same else len(x)), len(x) + (0 if same else len(y)))
                li.append(i)
                lj.append(j)
        i, j = np.concatenate(li), np.concatenate(lj)
        both = rows_a if same else np.concatenate([rows_a, rows_b])
        links = _forest(i, j, len(both))
        for row, n in [(rows_a, count_x)] + ([] if same else [(rows_b, count_y)]):
            some = n > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(n[some]), pa.nulls(int(some.sum()), pa.int64())], names=["row", "n", "other"])
        if links:
            i, j = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(both[i]), pa.nulls(len(i), pa.int64()), pa.array(both[j])], names=["row", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r] for c in batch.schema.names}
                block, d = x["block"].as_py(), x["d"].as_py()
                vectors = unit(np.frombuffer(x["data"].as_buffer(), np.float32 if narrow else np.float64).reshape(-1, d))
                one = block, np.array(x["rows"].as_py()), np.array(x["copies"].as_py()), vectors
                if (x["tile"].as_py(), x["part"].as_py()) != group:
                    group, held = (x["tile"].as_py(), x["part"].as_py()), {}
                if x["partners"].as_py() is None:
                    held[block] = one
                    continue
                for a in x["partners"].as_py():
                    yield from compared(held[a], one)

    passing = cut(pairs.groupBy("tile", F.col("b").alias("block")).agg(F.sort_array(F.collect_set("a")).alias("partners")))
    parts = passing.groupBy("tile").agg(F.ceil(F.sum(F.size("partners")) / TILE_PAIRS).cast("int").alias("parts"))
    passing = passing.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).select("tile", "part", "block", "partners")
    held = passing.select("tile", "part", F.explode("partners").alias("block")).distinct().select("tile", "part", "block", F.lit(None).cast("array<long>").alias("partners"))
    sent = held.union(passing).join(packed.select("block", "d", "rows", "copies", "data"), "block")
    columns = ["tile", "part", "block", "partners", "d", "rows", "copies", "data"]
    return sent.select(*columns).repartition("tile", "part").sortWithinPartitions("tile", "part", F.col("partners").isNotNull(), "block").transform(mapped, run, "row long, n long, other long")


def link(vectors: DataFrame, cosine: float = COSINE, vector: str = "embedding", key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    rows = prepared(vectors, vector, key)
    single, made = classes(rows)
    packed = blocks(cut(single), epsilon, block)
    found = cut(compare(near_blocks(packed.select("block", "d", "lo", "hi"), epsilon), packed, cosine, "float" in rows.schema["v"].dataType.simpleString()))
    counts = found.where("other is null").groupBy("row").agg(F.sum("n").alias("n"))
    links = found.where("other is not null").select(F.col("row").alias("a"), F.col("other").alias("b"))
    sound = rows.where("v is not null")
    if sound.groupBy("id").count().where("count > 1").limit(1).count():
        # Rows that repeat an id are one node: their classes are linked.
        named = sound.select("id", "digest").join(made.select("digest", "row"), "digest")
        first = named.groupBy("id").agg(F.min("row").alias("a"))
        links = links.union(cut(named.join(first, "id").where("a < row").select("a", F.col("row").alias("b")).distinct()))
    comps = components(links)
    whole = made.join(comps, made.row == comps.node, "left").withColumn("component", F.coalesce("component", "row"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = whole.join(least, "component").join(counts, "row", "left").select("digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "digest").join(facts, "digest", "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""
