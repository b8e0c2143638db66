"""Packing documents into token windows by lexical retrieval.

A document is its token ids and an end id. Whole windows of it stand alone; what is left over is packed shard by shard: a BM25 inverted index over the shard's remainders gives, for each seed, its best unused neighbours, which fill the window one after another. A neighbour that does not fit is cut, and its rest is the next seed, so windows are full. What a shard leaves starts the next; a partition's last rest is cut into powers of two, which need no padding.

A shard is a bounded run of a partition's rows, so nothing is shuffled and a lost executor repeats its partitions with the same result.

Edge cases: a null text counts as empty, that is the end id alone. Repeated rows are documents of their own. Very long texts fill windows of their own. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mapped, process_cache, table

WINDOW, END = 1024, 0
#: Documents and remainder tokens of a shard; cached words of a worker.
SHARD, SHARD_TOKENS, CACHED = 1024, 1 << 20, 200_000
K1, B = 1.2, 0.75

_SPACES = re.compile(r"\s\s")
_PLACE = re.compile(r"(?<=\S) (?=\S)")


class Words(dict):
    """Token ids, as bytes, of words after a space. Words seldom recur beyond the first many, so later ones are not kept."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary
        self.encoding, self.added = encoding, tuple(encoding.special_tokens_set)

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(" " + word)).tobytes()
        if len(self) < CACHED:
            self[word] = ids
        return ids

    def holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added)


def words(vocabulary: str | None = None) -> Words:
    """The worker's tokenizer, from a file of base64 tokens and ranks, and the added tokens of the .json file beside it, if there is one; by default the installed byte-level vocabulary."""
    cache = process_cache()
    key = ("tokenizer", vocabulary)
    if key not in cache:
        import public_tokenizers
        import tiktoken

        at = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        beside = Path(at).with_suffix(".json") if vocabulary else Path(public_tokenizers.path("byte_bpe_50k.json"))
        added = {x["content"]: x["id"] for x in json.loads(beside.read_text("utf-8")).get("added_tokens", [])} if beside.exists() else {}
        with open(at, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[key] = Words(tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in added.values()}, special_tokens=added))
    return cache[key]


def tokens(text: str, known: Words) -> np.ndarray:
    """The text's ids and the end id. A single space between other signs always begins a token, so a text is the sum of its words. One with an added token is read whole, as the vocabulary's own tokenizer matches it inside the text."""
    end = END.to_bytes(4, "little")
    if known.holds_added(text):
        return np.frombuffer(array("I", known.encoding.encode(text, allowed_special="all")).tobytes() + end, np.uint32)
    parts = _PLACE.split(text) if _SPACES.search(text) or text[-1:].isspace() else text.split(" ")
    ids = array("I", known.encode(parts[0])).tobytes() if parts[0] else b""
    return np.frombuffer(ids + b"".join([known[w] for w in parts[1:]]) + end, np.uint32)


class Index:
    """BM25 postings over a shard's remainders. Terms that stand in one only, or in so many that their idf is not positive, say nothing about neighbours."""

    def __init__(self, items: list[np.ndarray]):
        self.n = n = len(items)
        size = np.array([len(x) for x in items])
        flat = np.concatenate(items).astype(np.int64) * n + np.repeat(np.arange(n), size)
        key, tf = np.unique(flat, return_counts=True)
        term, item = key // n, key % n
        fresh = np.concatenate([[True], term[1:] != term[:-1]])
        number = np.cumsum(fresh) - 1
        df = np.bincount(number)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        keep = ((df > 1) & (idf > 0))[number]
        number, item, tf = number[keep], item[keep], tf[keep]
        norm = K1 * (1 - B + B * size / size.mean())
        self.item, self.weight = item, idf[number] * tf * (K1 + 1) / (tf + norm[item])
        ends = np.cumsum(np.bincount(number, minlength=len(df)))
        self.start, self.end = np.concatenate([[0], ends[:-1]]), ends
        order = np.argsort(item, kind="stable")
        self.terms, self.at = number[order], np.searchsorted(item[order], np.arange(n + 1))

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every item for the terms of one."""
        t = self.terms[self.at[item] : self.at[item + 1]]
        start, size = self.start[t], self.end[t] - self.start[t]
        total = int(size.sum())
        where = np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)
        return np.bincount(self.item[where], self.weight[where], minlength=self.n)


def fill(items: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length); all full but the last."""
    if not items:
        return
    index = Index(items) if len(items) > 1 else None
    unused, done, first, pending = np.ones(len(items), bool), [0] * len(items), 0, -1
    while True:
        while first < len(items) and not unused[first]:
            first += 1
        seed, pending = (pending, -1) if pending >= 0 else (first, -1)
        if seed >= len(items):
            return
        here, room, score, at = [], window, None, seed
        while True:
            unused[at] = False
            take = min(room, len(items[at]) - done[at])
            here.append((at, done[at], take))
            done[at] += take
            room -= take
            if done[at] < len(items[at]):
                pending = at
            if not room:
                break
            if score is None and index is not None:
                score = index.scores(seed)
            best = int((score * unused).argmax()) if index is not None else -1
            if best < 0 or score[best] <= 0 or not unused[best]:
                while first < len(items) and not unused[first]:
                    first += 1
                best = first
            if best >= len(items):
                break
            at = best
        yield here


def powers(n: int) -> list[int]:
    """n as powers of two, falling."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(vocabulary)
        count = TaskContext.get().partitionId() << 33
        rest: list[tuple] = []  # (doc, start, ids, tokens of the document)
        size = 0
        rows: list[tuple] = []

        def sequence(parts: list[tuple[tuple, int, int]]) -> None:
            nonlocal count
            at = 0
            for (doc, start, ids, whole), lo, n in parts:
                rows.append((doc, start + lo, n, ids[lo : lo + n].tobytes(), whole, count, at))
                at += n
            count += 1

        def shard(last: bool) -> None:
            nonlocal rest, size
            kept: list[tuple] = []
            for w in fill([r[2] for r in rest], window):
                parts = [(rest[i], lo, n) for i, lo, n in w]
                if sum(n for _, _, n in parts) == window:
                    sequence(parts)
                elif not last:
                    kept = [(d, s + lo, ids[lo : lo + n], whole) for (d, s, ids, whole), lo, n in parts]
                else:
                    for p in powers(sum(n for _, _, n in parts)):
                        some = []
                        while p:
                            r, lo, n = parts[0]
                            take = min(p, n)
                            some.append((r, lo, take))
                            parts[:1] = [(r, lo + take, n - take)] if take < n else []
                            p -= take
                        sequence(some)
            rest, size = kept, sum(len(r[2]) for r in kept)

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = zip(*rows, strict=True)
                types = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                rows.clear()

        doc_type = None
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for doc, t in zip(b.column("doc_id").to_pylist(), encoded(b), strict=True):
                ids = tokens(t.decode("utf-8", "replace"), known)
                whole = len(ids) // window * window
                for lo in range(0, whole, window):
                    sequence([((doc, 0, ids, len(ids)), lo, window)])
                if whole < len(ids):
                    rest.append((doc, whole, ids[whole:].copy(), len(ids)))
                    size += len(ids) - whole
                if len(rest) >= SHARD or size >= SHARD_TOKENS:
                    shard(False)
                if len(rows) >= 2048:
                    yield from out()
        shard(True)
        yield from out()

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(mapped, run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digested(pack(table(spark, sf_dir, "documents").select("doc_id", "text")))
