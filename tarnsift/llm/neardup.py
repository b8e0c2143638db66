"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Documents with equal shingle sets are one class from the start. The classes' signatures are cut into bands; classes that share a band are candidates. Signatures are compared batch by batch, and a pair leaves as soon as the posterior chance that its similarity reaches the threshold falls under the chosen miss probability. Survivors are verified on the full sets, and verified links are closed into components.

No bucket emits all its pairs. In the first turn each bucket has a leader, the class whose buckets hold most, with which its other members are compared and verified; a group of near copies closes here. In the second, a bucket that still holds several components compares the members outside its largest one with all others of another component, dealt in blocks of bounded rows and bytes. Where few pairs survive these are verified on the texts; where many do, the members named get their sets, every survivor is verified where it stands, and only a spanning forest of the links leaves.

A shingle is named by 128 bits made of keyed digests of its words.

Edge cases: a null text, an empty one and one of separators only have no shingles and link with nothing; they stand alone. A text of fewer words than a shingle is one shingle. Very long texts are read whole. Rows that repeat a doc_id are one node. A row with null doc_id links with nothing: its component is null and it is kept. Ids may be of any type that has an order. Ties do not arise, as the least doc_id names a component. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, mapped, shingle_sets, slices, table
from .graph import components

HASHES = 128
BATCH = 32
#: Chance to prune a pair that reaches the threshold, and to share no band at the threshold.
MISS, BAND_MISS = 1e-5, 1e-6
#: Rows and bytes of sets of a block, pairs of one leader in a task, and survivors a row up to which a group emits them as pairs.
BLOCK, BLOCK_BYTES, FOLLOWERS, FEW = 512, 32 << 20, 256, 8
#: At most so many rows of two or three longs are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def band_rows(threshold: float, hashes: int = HASHES, miss: float = BAND_MISS) -> tuple[int, int]:
    """(bands, rows of each): the most rows whose chance to share no band at the threshold stays under miss."""
    for r in range(8, 1, -1):
        b = hashes // r
        if (1 - threshold**r) ** b <= miss:
            return b, r
    return hashes, 1


def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes, fewer than m matches leave the pair. With a uniform prior, the similarity's posterior is Beta(m + 1, n - m + 1), whose tail over t is the chance of at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        for m in range(n + 2):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if total >= miss:
                break
        out.append((n, m))
    return out


def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least of each linear hash over the set."""
    x = (s[:, 0] >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * a + b).min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n (set size), digest of the set, signature; both null for an empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(HASHES)
        for batch in batches:
            texts = encoded(batch)
            n, digest, sig = [], [], []
            for lo, hi in slices(texts):
                for s in shingle_sets(texts[lo:hi], k):
                    n.append(len(s))
                    digest.append(_digest(s) if len(s) else None)
                    sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "digest", "sig"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(mapped, run, f"doc_id {kind}, n long, digest binary, sig binary")


def reaches(one: np.ndarray, two: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets, as sorted distinct rows, have den * |A & B| >= num * |A | B|."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if den * len(small) < num * len(large):
        return False
    if (small[1:, 0] == small[:-1, 0]).any() or (large[1:, 0] == large[:-1, 0]).any():
        common = len(set(map(tuple, small.tolist())) & set(map(tuple, large.tolist())))
    else:
        at = np.minimum(np.searchsorted(large[:, 0], small[:, 0]), len(large) - 1)
        common = int((large[at] == small).all(axis=1).sum())
    return den * common >= num * (len(one) + len(two) - common)


class Judge:
    """Which pairs of signatures may reach the threshold."""

    def __init__(self, threshold: tuple[int, int], rows: int):
        self.num, self.den = threshold
        self.least = least_matches(self.num / self.den)
        self.rows = rows

    def survivors(self, x: dict, i: np.ndarray, y: dict, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices into x and y of the pairs that sizes and signatures allow, with their matches."""
        if not len(i):
            return i, j, np.zeros(0, np.int64)
        small, large = np.minimum(x["n"][i], y["n"][j]), np.maximum(x["n"][i], y["n"][j])
        keep = small * self.den >= large * self.num
        i, j = i[keep], j[keep]
        matches = np.zeros(len(i), np.int64)
        for n, m in self.least:
            for at in range(0, len(i), 1 << 16):
                s = slice(at, at + (1 << 16))
                matches[s] += (x["sig"][i[s], n - BATCH : n] == y["sig"][j[s], n - BATCH : n]).sum(axis=1)
            keep = matches >= m
            i, j, matches = i[keep], j[keep], matches[keep]
        return i, j, matches

    def between(self, rest: dict, block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Survivors between components, of the rest with a block, that no earlier band holds; a pair within the rest once."""
        for a in range(0, len(rest["id"]), 128):
            b = min(a + 128, len(rest["id"]))
            keep = (rest["comp"][a:b, None] != block["comp"]) & (~block["apart"] | (rest["id"][a:b, None] < block["id"]))
            i, j = np.nonzero(keep)
            i, j, w = self.survivors(rest, i + a, block, j)
            if len(i):
                earlier = np.zeros(len(i), bool)
                band = rest["band"][i]
                for k in range(int(band.max())):
                    part = slice(k * self.rows, (k + 1) * self.rows)
                    earlier |= (k < band) & (rest["sig"][i, part] == block["sig"][j, part]).all(axis=1)
                i, j, w = i[~earlier], j[~earlier], w[~earlier]
            if len(i):
                yield i, j, w


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def likely(pairs: DataFrame, facts: DataFrame, threshold: tuple[int, int], rows: int) -> DataFrame:
    """The pairs (a, b) that survive on their signatures. facts: (id, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(threshold, rows)
        for b in batches:
            x, y = ({"n": b.column(f"n_{c}").to_numpy(), "sig": _signature_rows(b.column(f"sig_{c}"))} for c in "ab")
            i, _, _ = judge.survivors(x, np.arange(b.num_rows), y, np.arange(b.num_rows))
            yield b.select(["a", "b"]).take(pa.array(i))

    side = lambda c: facts.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").transform(mapped, run, "a long, b long")


GROUP = ["bucket", "block", "chunk"]


def _groups(members: DataFrame, threshold: tuple[int, int], rows: int, found, schema: str) -> DataFrame:
    """Streams members (bucket, block, chunk, apart, rest, id, band, n, comp, sig, perhaps set) by group; found makes batches of one whole group, given as rest and block."""
    columns = [*GROUP, "rest", "apart", "id", "band", "n", "comp"]
    has_set = "set" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(threshold, rows)
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            x = {c: t.column(c).to_numpy() for c in columns}
            x["sig"] = _signature_rows(t.column("sig"))
            if has_set:
                x["set"] = np.array([*t.column("set").to_pylist(), None], object)[:-1]
            change = np.flatnonzero(np.any([x[c][1:] != x[c][:-1] for c in GROUP], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), t.num_rows], strict=True):
                part = {c: v[lo:hi] for c, v in x.items()}
                yield from found(judge, *({c: v[part["rest"] == side] for c, v in part.items()} for side in (True, False)))

        for b in batches:
            if not b.num_rows:
                continue
            last = np.all([b.column(c).to_numpy() == b.column(c)[-1].as_py() for c in GROUP], axis=0)
            begins = int(last.argmax())
            open_ = bool(held) and begins == 0 and all(held[-1].column(c)[-1] == b.column(c)[0] for c in GROUP)
            if not open_ and (held or begins):
                yield from emit(pa.Table.from_batches([*held, b.slice(0, begins)]))
                held = []
            held.append(b.slice(begins))
        if held:
            yield from emit(pa.Table.from_batches(held))

    return members.select(*columns, "sig", *(["set"] if has_set else [])).repartition(*GROUP).sortWithinPartitions(*GROUP, "rest", "id").transform(mapped, run, schema)


def candidates(members: DataFrame, threshold: tuple[int, int], rows: int, few: int = FEW) -> DataFrame:
    """(bucket, block, chunk, a, b): the survivors of each group where they are few; else, with null b, the members that they name."""

    def found(judge: Judge, rest: dict, block: dict) -> Iterator[pa.RecordBatch]:
        a, b, n, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, few * (len(rest["id"]) + len(block["id"]))
        named = np.zeros(len(rest["id"]), bool), np.zeros(len(block["id"]), bool)
        for i, j, _ in judge.between(rest, block):
            n += len(i)
            named[0][i] = named[1][j] = True
            if n <= most:
                a.append(np.minimum(rest["id"][i], block["id"][j]))
                b.append(np.maximum(rest["id"][i], block["id"][j]))
        if n:
            some = n <= most
            one = np.concatenate(a) if some else np.unique(np.concatenate([rest["id"][named[0]], block["id"][named[1]]]))
            two = pa.array(np.concatenate(b)) if some else pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(one), (rest[c] if len(rest[c]) else block[c])[0])) for c in GROUP), pa.array(one), two], names=[*GROUP, "a", "b"])

    return _groups(members, threshold, rows, found, "bucket long, block int, chunk int, a long, b long")


def exact_links(members: DataFrame, threshold: tuple[int, int], rows: int) -> DataFrame:
    """(a, b), a spanning forest of each group's links between components, verified on the members' sets."""

    def found(judge: Judge, rest: dict, block: dict) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}

        def find(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        sets = [[np.frombuffer(s, np.uint64).reshape(-1, 2) for s in x["set"]] for x in (rest, block)]
        out: tuple[list[int], list[int]] = ([], [])
        for i, j, w in judge.between(rest, block):
            for e in np.argsort(-w, kind="stable").tolist():
                a, b = int(i[e]), int(j[e])
                p, q = find(int(rest["comp"][a])), find(int(block["comp"][b]))
                if p != q and reaches(sets[0][a], sets[1][b], judge.num, judge.den):
                    joined[max(p, q)] = min(p, q)
                    out[0].append(int(rest["id"][a]))
                    out[1].append(int(block["id"][b]))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return _groups(members, threshold, rows, found, "a long, b long")


def _small_or_whole(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most so many rows, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def verified(pairs: DataFrame, texts, k: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b), a < b, whose full shingle sets reach the threshold. texts adds digest and text to rows with an id; of rows that share a doc_id, only those with the class's digest count. The partners of one a stand in tasks of FOLLOWERS, each with one copy of its text."""
    num, den = threshold
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")).where("parts > 1")
    dealt = pairs.join(_small_or_whole(many), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).select("a", "part", "b")
    heads = dealt.select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
    roles = heads.union(dealt.select(F.col("b").alias("id"), "a", "part", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, set_ = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, part, b, digest, t in zip(*(batch.column(c) for c in ("a", "part", "b", "digest", "text")), strict=True):
                here = a.as_py(), part.as_py()
                s = shingle_sets([t.cast(pa.binary()).as_py() or b""], k)[0]
                if _digest(s) != digest.as_py():
                    continue
                if b.as_py() is None:
                    head, set_ = here, s
                elif head == here and reaches(set_, s, num, den):
                    found[0].append(here[0])
                    found[1].append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    both = texts(roles).select("a", "part", "b", "digest", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return both.transform(mapped, run, "a long, b long").distinct()


def hashed(texts: DataFrame, k: int) -> DataFrame:
    """(id, set), the shingles as bytes, from (id, digest, text); rows whose set has another digest go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, digests = encoded(batch), batch.column("digest").to_pylist()
            ids, sets = [], []
            for lo, hi in slices(data):
                for r, s in zip(range(lo, hi), shingle_sets(data[lo:hi], k), strict=True):
                    if _digest(s) == digests[r]:
                        ids.append(batch.column("id")[r].as_py())
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])

    return texts.select("id", "digest", "text").transform(mapped, run, "id long, set binary").dropDuplicates(["id"])


def cluster(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), text: str = "text", key: str = "doc_id", block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Links are pairs with den * |A & B| >= num * |A | B| for threshold (num, den)."""
    bands, rows = band_rows(threshold[0] / threshold[1])
    sigs = cut(signatures(docs, k, text, key)).withColumn("row", F.monotonically_increasing_id())
    able = sigs.where("n > 0 and doc_id is not null")
    classes = cut(able.groupBy("digest").agg(F.min("row").alias("id"), F.min("doc_id").alias("least")))
    reps = cut(able.join(classes.select("id"), able.row == classes.id).select("id", "n", "sig", "digest", "doc_id"))
    facts = reps.select("id", "n", "sig")

    links = None
    if able.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Rows that repeat a doc_id are one node: their classes are linked.
        named = able.select("doc_id", "digest").join(classes.select("digest", "id"), "digest")
        first = named.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = cut(named.join(first, "doc_id").where("a < id").select("a", F.col("id").alias("b")).distinct())

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def texts_of(rows: DataFrame) -> DataFrame:
        wanted = cut(rows.join(reps.select("id", "doc_id", "digest"), "id"))
        return source.join(_small_or_whole(wanted), "doc_id")

    keys = reps.select("id", "n", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {2 * rows * i + 1}, {2 * rows})")) for i in range(bands)])).alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(keys.join(shared, "bucket"))
    # The text that others were made from shares most of its bands with most of them, so its buckets are the largest.
    weighed = buckets.join(buckets.groupBy("id").agg(F.sum("size").alias("weight")), "id")
    leaders = weighed.groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("leader"))
    buckets = cut(buckets.join(leaders, "bucket").where("id <> leader"))
    pairs = cut(likely(buckets.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct(), facts, threshold, rows))
    new = cut(verified(pairs, texts_of, k, threshold))
    links = new if links is None else links.union(new)
    comps = components(links)

    # Pairs with a leader are done; two more members at least make another pair.
    placed = buckets.where("size > 2").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component", "leader", "size")
    by_comp = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    whole = by_comp.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.struct("size", "n", "comp")).alias("most")).where("comps > 1")
    parts = lambda size, n: F.greatest(F.ceil(size / block), F.ceil(n * 16 / BLOCK_BYTES)).cast("int")
    whole = whole.select("bucket", F.col("most.comp").alias("giant"), parts(F.col("size"), F.col("n")).alias("blocks"), parts(F.col("size") - F.col("most.size"), F.col("n") - F.col("most.n")).alias("chunks"))
    placed = cut(placed.join(whole, "bucket").withColumn("apart", F.col("comp") != F.col("giant")))
    if placed.limit(1).count():
        own = lambda of, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        one = placed.withColumn("rest", F.lit(False)).withColumn("block", own("blocks", 1)).withColumn("chunk", each("chunks"))
        two = placed.where("apart").withColumn("rest", F.lit(True)).withColumn("block", each("blocks")).withColumn("chunk", own("chunks", 2))
        members = one.unionByName(two).drop("n")
        got = cut(candidates(members.join(facts, "id"), threshold, rows, few))
        few = cut(got.where("b is not null").select("a", "b").distinct())
        if few.limit(1).count():
            links = links.union(cut(verified(few, texts_of, k, threshold)))
            comps = components(links)
        many = cut(got.where("b is null").select(*GROUP, F.col("a").alias("id")))
        if many.limit(1).count():
            sets = cut(hashed(texts_of(many.select("id").distinct()), k))
            fresh = members.join(many, [*GROUP, "id"]).drop("comp").join(comps.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            links = links.union(cut(exact_links(fresh.join(facts, "id").join(sets, "id"), threshold, rows)))
            comps = components(links)
    named = comps.join(classes.select("id", "least"), comps.node == classes.id)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    reach = named.join(least, "component").select("id", "component_id")
    reach = classes.join(reach, "id", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(reach, "digest", "left")
    own_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, (85, 100))
