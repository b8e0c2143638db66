"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on quantile-binned statistics of a bounded, labelled sample, and flattened into arrays; whole batches walk them with numpy.

Edge cases: a null text counts as empty and is scored like it. Without labels of both kinds the score is the share of label 1 (1 without any label). Several labels of one document count each. Repeated rows are scored alike; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, fold, held_out, mapped, mix, slices, table, word_hashes

#: Training takes at most so many labelled rows, by a hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 80, 4, 64, 0.15, 20.0, 1.0
CUTOFF = 0.3

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>=+_\\/{}[]",
    "quote": b"\"'()-",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "wide": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _TABLE[list(_c), _i] = 1
NAMES = ["log_bytes", *_CLASSES, "entropy", "log_words", "word_bytes", "distinct", "top_word", "pairs", "fives", "lines", "line_words"]


def _repeats(h: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and of the most frequent one."""
    if not len(h):
        return 1.0, 0.0
    s = np.sort(h)
    ends = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]]))
    return len(ends) / len(h), float(np.diff(ends, prepend=-1).max()) / len(h)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of document statistics for each text: shares of byte classes, entropy, lengths, and how much words, word pairs, five-word runs and lines repeat."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, hi in slices(texts):
        h, at = word_hashes(texts[lo:hi])
        pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
        fives = h.copy()
        for i in range(1, 5):
            fives[: len(h) - i] = mix(fives[: len(h) - i] * np.uint64(5) + h[i:]) if len(h) > i else fives[: len(h) - i]
        for r, t in enumerate(texts[lo:hi]):
            n, a, b = len(t), int(at[r]), int(at[r + 1])
            counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
            share = counts[counts > 0] / max(1, n)
            lines = [x for x in t.split(b"\n") if x.strip()]
            words = h[a:b]
            distinct, top = _repeats(words)
            out[lo + r] = [np.log1p(n), *(counts @ _TABLE / max(1, n)), -(share * np.log2(share)).sum() if n else 0, np.log1p(b - a), n / max(1, b - a), distinct, top, _repeats(pairs[a : max(a, b - 1)])[0], _repeats(fives[a : max(a, b - 4)])[0], len(set(lines)) / max(1, len(lines)), (b - a) / max(1, len(lines))]
    return out


@dataclass
class Forest:
    """Complete binary trees as arrays: node i of a tree has children 2i + 1 and 2i + 2; a node that does not split sends all to the left."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = LEAST, l2: float = L2) -> Forest:
    """Logistic loss, second order. Each level's histograms of all nodes come from one bincount per statistic."""
    inner = 2**depth - 1
    base = float(y.mean()) if len(y) else 1.0
    start = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    if not len(y) or base in (0.0, 1.0):
        return Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, low = 2**level, 2**level - 1
            best = np.zeros(width)
            split = np.full(width, bins)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                slot = (node - low) * bins + binned[:, f]
                hist = lambda w: np.bincount(slot, w, width * bins).reshape(width, bins).cumsum(axis=1)  # noqa: B023, E731
                gs, hs = hist(g), hist(h)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least * 0.05) | (ht - hs < least * 0.05)] = 0
                gain[:, len(c) :] = 0
                at = gain.argmax(axis=1)
                here = gain[np.arange(width), at]
                better = here > best + 1e-9
                best[better], split[better] = here[better], at[better]
                feature[low : low + width][better] = f
                threshold[low : low + width][better] = c[at[better]]
            mine = node - low
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[mine])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(start, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from at most about `rows` labelled documents outside the held-out fold, whose statistics alone come to the driver."""
    named = labels.where(F.col(label).isNotNull() & (fold(F.col(key)) != 0)).select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("y"))
    n = named.count()
    share = min(1.0, rows / max(1, n))
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality sample")), F.lit(1 << 30)) / float(1 << 30)
    # The share bounds the sample to about `rows` pairs of an id and a number, so it may be broadcast.
    sample = named.where(u < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(encoded(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").transform(mapped, run, f"doc_id {kind}, y double, x array<double>").toPandas()
    if not len(got):
        return grow(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.stack(got["x"].to_list())
    # In an order of their own, so that sums do not depend on which task came first.
    order = np.lexsort([*x.T, got["y"].to_numpy(), got["doc_id"].to_numpy()])
    return grow(x[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, model: Forest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, score."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(statistics(encoded(b))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(mapped, run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Forest, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows, as they are, whose text scores at least the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(encoded(b, text))) >= cutoff))

    return docs.transform(mapped, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
