"""What the operators share: Arrow mapping, checkpoints, folds, word hashing."""

from __future__ import annotations

import hashlib
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CLASS = r"[^\x20\x09-\x0D]+"
FOLDS = 5


#: Rows and bytes of an Arrow batch, unless the session names its own: whole texts are long, and two or more Python workers share an executor's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in small batches."""
    conf = df.sparkSession.conf
    given = conf.getAll
    for k, v in BATCHES.items():
        if k not in given:
            conf.set(k, v)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A small table of the driver's own. Through Arrow the JVM reads it by itself; from a list it would start further Python workers."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: What open scopes of scratch() have written, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what cut() and shared_folder() have written to the shared folder meanwhile. The results must be stored elsewhere by then."""
    here: list[str] = []
    _SCOPES.append(here)
    try:
        yield
    finally:
        _SCOPES.remove(here)
        for at in here:
            remove(spark, at)


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages reread it, also when executors are lost."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _SCOPES:
        at = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if at.isDefined():
            _SCOPES[-1].append(at.get())
    return out


def fresh(name: str, taken: list[str]) -> str:
    """The name, or with so many more underscores that no column has it, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_tarnsift_cache", {})


def encoded(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8, null as empty, straight from Arrow's buffer."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


# Two ways to name words. Statistics and contexts take polynomials modulo a prime, a few numpy passes for a batch; what must tell texts apart takes a keyed digest of each distinct word.

_PRIME = (1 << 31) - 1
_BASES = (1_234_567_891, 987_654_323)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x under 2^62."""
    p = np.uint64(_PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, at least n of them."""
    cache = process_cache()
    if n > cache.get("powers_n", 0):
        size = max(n, 1 << 20)
        made = []
        for base in _BASES:
            pair = []
            for r in (base, pow(base, -1, _PRIME)):
                x = np.ones(size, np.uint64)
                k = 1
                while k < size:
                    more = min(k, size - k)
                    x[k : k + more] = _reduced(x[:more] * np.uint64(pow(r, k, _PRIME)))
                    k *= 2
                pair.append(x)
            made.append(tuple(pair))
        if size > 1 << 22:
            return made
        cache["powers"], cache["powers_n"] = made, size
    return cache["powers"]


def _byte_table(lower: bool, salt: int) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += np.uint64(32)
    return mix(b + np.uint64(0x632BE59BD9B4E019 + salt)) % np.uint64(_PRIME - 1) + np.uint64(1)


def run_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges, from polynomials to two bases modulo 2^31 - 1; lower folds A-Z only."""
    out = (ends - starts).astype(np.uint64)
    for k, (up, down) in enumerate(_powers(len(joined) + 1)):
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_reduced(_byte_table(lower, k)[joined] * up[: len(joined)]), out=sums[1:])
        out = mix(out ^ _reduced(_reduced(sums[ends] - sums[starts]) * down[starts]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts with a space after each, starts and ends of the words, index of each text's first word and one more). Words are runs without space or \\t-\\r."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(joined) and inside[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[::2], change[1::2]
    return joined, starts, ends, np.concatenate([[0], np.searchsorted(starts, ends_of)])


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one longer than texts)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    joined, starts, ends, at = runs(texts)
    return run_hashes(joined, starts, ends, lower), at


class Digests(dict):
    """Keyed 128-bit digests of distinct words; words beyond the first many are not kept."""

    KEPT = 1 << 18

    def __missing__(self, word: bytes) -> bytes:
        d = hashlib.blake2b(word, digest_size=16, key=b"shingles").digest()
        if len(self) < self.KEPT and len(word) < 256:
            self[word] = d
        return d


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPREAD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _sorted_set(g: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct rows (n, 2), sorted."""
    order = np.argsort(g[0])
    x, y = g[0][order], g[1][order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((g[1], g[0]))
        x, y = g[0][order], g[1][order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    return np.stack([x[new], y[new]], axis=1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, A-Z folded, as sorted rows of two 64-bit numbers made of the digests of its words; a shorter text is one shingle, one without words none."""
    known = process_cache().setdefault("digests", Digests())
    # bytes.split() parts at space and \\t-\\r, as words are meant here.
    words = [t.translate(_LOWER).split() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    h = np.frombuffer(b"".join([known[w] for some in words for w in some]), np.uint64).reshape(-1, 2)

    def shingled(lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        g = [np.full(hi - lo - n + 1, 0 if n == k else n, np.uint64) for _ in "ab"]
        for i in range(n):
            g = [mix(x * m + h[lo + i : hi - n + 1 + i, c]) for c, (x, m) in enumerate(zip(g, _SPREAD, strict=True))]
        return tuple(g)

    whole = shingled(0, len(h), k) if len(h) >= k else None
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(_sorted_set(tuple(x[a : b - k + 1] for x in whole)))
        else:
            out.append(_sorted_set(shingled(a, b, b - a)) if b > a else np.zeros((0, 2), np.uint64))
    return out


def slices(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of about limit bytes, one text at least."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
