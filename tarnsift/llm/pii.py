"""Personal data: fixed patterns, and contexts learned from what these find.

Fixed patterns give the base spans. Each is a seed: the words beside it become lexical contexts, and Spark scores the bipartite graph of contexts and the strings found in them by turns, until nothing changes (a context is as good as the share of its occurrences whose string is believed; a string is believed as the best of its contexts says). Contexts that end with high confidence and enough different seeds then mark the strings that no fixed pattern covers, of any shape and of up to MAX_WORDS words. Shape counts apart from context: a string of letters alone is never believed, and is marked only where the contexts on both sides hold.

The texts are read three times, numpy looking words up: for the contexts of seeds; for how often strings of letters alone stand in these, which rules most out; and for the places of those left. Workers get the contexts as a bit table of a fixed size, whatever their number; what it lets through by chance falls to the exact join that follows. Contexts and strings are named by 64-bit hashes.

Edge cases: a null text counts as empty, with no spans. Repeated rows are answered alike; their occurrences count each, but a context needs SUPPORT different seed strings. An empty table gives no rows. Very long texts are read whole, in memory of some times their size. Ties do not arise: a place is marked or not. Further columns are never read. Matches of the fixed patterns fail as a whole: there is no retry within a failed match.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, mapped, mix, process_cache, run_hashes, runs, slices, table

KINDS = ("email", "ip", "card", "phone")
LEARNED = "context"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Contexts count from so many distinct seed strings; with less confidence than this they mark nothing. Turns at most.
SUPPORT, CONFIDENCE, TURNS = 3, 0.8, 20
#: Words of a string without a fixed pattern.
MAX_WORDS = 8
#: Bits of the table that workers look contexts up in, as a power of two, and where each of its three bits is taken from the hash.
TABLE_BITS, SHIFTS = 26, (0, 19, 38)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """A match holds one @, so each @ decides alone; this takes linear time where a search for the whole pattern would not."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b".,;:!?()[]{}\"'")] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;!?")] = True
_INNER = np.zeros(256, bool)
_INNER[list(b"@_+=/\\#:.0123456789")] = True
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _context(side: np.uint64, far, near):
    """Hash of the two words beside a string; 0 for a word that is not there. A context is never 0, but both missing are."""
    far, near = np.atleast_1d(far), np.atleast_1d(near)
    return np.where((far | near) != 0, mix(mix(far ^ side) + near * side) | np.uint64(1), np.uint64(0))


class Words:
    """The words of some texts: strings between blanks without the signs around them. Signs alone are no words."""

    def __init__(self, texts: list[bytes]):
        joined, starts, ends, at = runs(texts)
        self.joined = joined
        space = (joined == 32) | ((joined >= 9) & (joined <= 13))
        inner = np.flatnonzero(~space & ~_SIGNS[joined])
        lo, hi = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
        real = np.flatnonzero(lo < hi)
        self.a, self.b = inner[lo[real]] if len(real) else lo[:0], inner[hi[real] - 1] + 1 if len(real) else lo[:0]
        self.first = np.searchsorted(real, at)
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.h = run_hashes(joined, self.a, self.b) | np.uint64(1)
        self.ends = _ENDS[joined[ends[real] - 1]]
        count = lambda of: np.concatenate([[0], np.cumsum(of[joined])])
        digits = np.zeros(256, bool)
        digits[48:58] = True
        n, m = count(digits), count(_INNER)
        self.digit = n[self.b] > n[self.a]
        # Letters alone, at most with a sign at the edge: ordinary words have no such signs or digits inside.
        self.plain = ~self.digit & (m[np.maximum(self.b - 1, self.a)] <= m[np.minimum(self.a + 1, self.b)])
        # Words of the same text one and two before and after, as hashes.
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.doc = doc

        def moved(k: int) -> np.ndarray:
            out = np.zeros(len(doc), np.uint64)
            if k > 0:
                out[k:] = np.where(doc[k:] == doc[:-k], self.h[:-k], np.uint64(0))
            else:
                out[:k] = np.where(doc[:k] == doc[-k:], self.h[-k:], np.uint64(0))
            return out

        self.left, self.right = _context(_LEFT, moved(2), moved(1)), _context(_RIGHT, moved(-2), moved(-1))
        self.seeded = np.zeros(len(doc), bool)

    def points(self, doc: int) -> np.ndarray | None:
        """Byte offset of each code point of a text and of its end, or None where they are the same."""
        lo, hi = int(self.begins[doc]), int(self.begins[doc + 1]) - 1
        part = self.joined[lo:hi]
        return None if (part < 128).all() else np.concatenate([np.flatnonzero((part & 0xC0) != 0x80), [hi - lo]])

    def take(self, doc: int, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Marks the words of base spans; (left, right, value, lo, hi) of each, overlapping ones as one."""
        out, points = [], self.points(doc)
        base, f, e = int(self.begins[doc]), int(self.first[doc]), int(self.first[doc + 1])
        for lo, hi in _merged(spans):
            a, b = (lo, hi) if points is None else (int(points[lo]), int(points[hi]))
            i, j = f + int(np.searchsorted(self.b[f:e], base + a, "right")), f + int(np.searchsorted(self.a[f:e], base + b))
            h = lambda k: self.h[k] if f <= k < e else np.uint64(0)  # noqa: B023, E731
            self.seeded[i:j] = True
            out.append((int(_context(_LEFT, h(i - 2), h(i - 1))[0]), int(_context(_RIGHT, h(j + 1), h(j))[0]), self.value(base + a, base + b), lo, hi))
        return out

    def value(self, a: int, b: int) -> int:
        return int.from_bytes(hashlib.blake2b(self.joined[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)

    def places(self, doc: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int | None, int, int, bool, bool]]:
        """(left, right, value, lo, hi, False, plain) of the strings beside contexts, of which left and right hold the word numbers that follow and precede one.

        Beside a context stands the run of words with a digit that it touches, or one word without; a sign that ends a clause ends the run. Up to MAX_WORDS words between a left and a right context are a place without a value: it can be marked, but scores neither.
        """
        f, e = int(self.first[doc]), int(self.first[doc + 1])
        after, before = left[np.searchsorted(left, f) : np.searchsorted(left, e)].tolist(), (right[np.searchsorted(right, f) : np.searchsorted(right, e)] + 1).tolist()
        if not after and not before:
            return []
        found: list[tuple[int, int, int, int, bool]] = []  # left, right, first word, end word, scores
        for lo in after:
            hi = lo + 1
            while self.digit[lo] and hi < e and hi - lo < MAX_WORDS and self.digit[hi] and not self.seeded[hi] and not self.ends[hi - 1]:
                hi += 1
            found.append((int(self.left[lo]), 0, lo, hi, True))
            for hi in before[bisect_right(before, lo) : bisect_right(before, lo + MAX_WORDS)]:
                if self.seeded[lo:hi].any():
                    break
                found.append((int(self.left[lo]), int(self.right[hi - 1]), lo, hi, False))
        for hi in before:
            lo = hi - 1
            while self.digit[hi - 1] and lo > f and hi - lo < MAX_WORDS and self.digit[lo - 1] and not self.seeded[lo - 1] and not self.ends[lo - 1]:
                lo -= 1
            found.append((0, int(self.right[hi - 1]), lo, hi, True))
        points, base = self.points(doc), int(self.begins[doc])
        at = lambda x: x - base if points is None else int(np.searchsorted(points, x - base))
        return [(x, y, self.value(int(self.a[lo]), int(self.b[hi - 1])) if scores else None, at(int(self.a[lo])), at(int(self.b[hi - 1])), False, bool(self.plain[lo:hi].all())) for x, y, lo, hi, scores in found]


def _merged(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if isinstance(x, np.ndarray) else np.array(x, np.uint64).view(np.int64))


class Table:
    """Which contexts may be in a set: never no for a member."""

    def __init__(self, contexts: DataFrame):
        word = lambda k: F.shiftright(F.shiftrightunsigned("context", k).bitwiseAND(F.lit((1 << TABLE_BITS) - 1)), 6)
        bit = lambda k: F.shiftrightunsigned("context", k).bitwiseAND(F.lit(63))
        marks = contexts.select(F.explode(F.array(*[F.struct(word(k).alias("word"), bit(k).alias("bit")) for k in SHIFTS])).alias("x"))
        # At most 2^20 rows, as many as the table has words.
        got = marks.groupBy("x.word").agg(F.expr("bit_or(shiftleft(1L, cast(x.bit as int)))").alias("bits")).toArrow()
        self.empty = not got.num_rows
        order = np.argsort(got.column("word").to_numpy())
        self.packed = zlib.compress(got.column("word").to_numpy()[order].astype("<i8").tobytes() + got.column("bits").to_numpy()[order].astype("<i8").tobytes(), 1)
        self.name = hashlib.blake2b(self.packed, digest_size=16).digest()

    def may_hold(self, contexts: np.ndarray) -> np.ndarray:
        cache = process_cache()
        if cache.get("contexts", (None,))[0] != self.name:
            word, bits = np.frombuffer(zlib.decompress(self.packed), "<i8").reshape(2, -1)
            whole = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
            whole[word] = bits.view(np.uint64)
            cache["contexts"] = self.name, whole
        whole, out = cache["contexts"][1], contexts != 0
        for k in SHIFTS:
            at = (contexts >> np.uint64(k)) & np.uint64((1 << TABLE_BITS) - 1)
            out &= (whole[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[list[tuple[str, int, int]]], list[list[tuple[int, int, int, int, int]]]]]:
    """Words, base spans and seeds of a batch's texts, slice by slice."""
    data = encoded(batch)
    for lo, hi in slices(data):
        spans = [base_spans(t.decode("utf-8", "replace")) for t in data[lo:hi]]
        words = Words(data[lo:hi])
        yield words, spans, [words.take(i, s) if s else [] for i, s in enumerate(spans)]


def seed_contexts(texts: DataFrame) -> DataFrame:
    """(context, value, n): the seed strings of each context, with how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[int, int]] = []
            for _, _, seeds in _read(b):
                got += [(c, s[2]) for some in seeds for s in some for c in s[:2] if c]
            yield pa.RecordBatch.from_arrays([_signed([c for c, _ in got]), pa.array([v for _, v in got], pa.int64())], names=["context", "value"])

    return texts.transform(mapped, run, "context long, value long").groupBy("context", "value").agg(F.count("*").alias("n"))


def possible_contexts(texts: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(context) of those with enough seeds that can still hold if every string with a digit or a sign in them were believed; plain strings never are."""
    able = cut(seed_contexts(texts).groupBy("context").agg(F.count("*").alias("seeds"), F.sum("n").alias("n")).where(F.col("seeds") >= support).select("context", "n"))
    some = Table(able)
    if some.empty:
        return able.select("context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for words, _, _ in _read(b):
                for side in (words.left, words.right):
                    here = np.flatnonzero(~words.seeded & some.may_hold(side))
                    seen.append((side[here], words.plain[here]))
            c, plain = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.uint64), np.zeros(0, bool))
            names, back = np.unique(c, return_inverse=True)
            n, letters = np.bincount(back, minlength=len(names)), np.bincount(back, plain, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_signed(names), pa.array(letters, pa.int64()), pa.array((n - letters).astype(np.int64))], names=["context", "plain", "other"])

    counts = texts.transform(mapped, run, "context long, plain long, other long").groupBy("context").agg(F.sum("plain").alias("plain"), F.sum("other").alias("other"))
    other, plain = F.col("n") + F.coalesce("other", F.lit(0)), F.coalesce("plain", F.lit(0))
    return cut(able.join(counts, "context", "left").where(other >= confidence * (other + plain)).select("context"))


def extract(docs: DataFrame, contexts: Table, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, base (array of kind, lo, hi) and places (array of left, right, value, lo, hi, seed, plain) at contexts that the table lets through."""
    kind = docs.schema[key].dataType.simpleString()
    spans_t = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))
    names = ("left", "right", "value", "lo", "hi", "seed", "plain")
    places_t = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True))))
    long = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, places = [], []
            for words, spans, seeds in _read(b):
                left, right = (np.flatnonzero(~words.seeded & contexts.may_hold(side)) for side in (words.left, words.right)) if not contexts.empty else (np.zeros(0, np.int64),) * 2
                touched = set(words.doc[left].tolist()) | set(words.doc[right].tolist())
                for i, found in enumerate(spans):
                    base.append([{"kind": k, "lo": x, "hi": y} for k, x, y in found])
                    here = [(x, y, v, lo, hi, True, False) for x, y, v, lo, hi in seeds[i]] if not contexts.empty else []
                    here += words.places(i, left, right) if i in touched else []
                    places.append([dict(zip(names, (long(p[0]), long(p[1]), *p[2:]), strict=True)) for p in here])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, spans_t), pa.array(places, places_t)], names=["doc_id", "base", "places"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(mapped, run, f"doc_id {kind}, base array<struct<kind string, lo int, hi int>>, places array<struct<left long, right long, value long, lo int, hi int, seed boolean, plain boolean>>")


def learned_contexts(places: DataFrame, able: DataFrame, confidence: float = CONFIDENCE, turns: int = TURNS) -> DataFrame:
    """(context, confidence) of the contexts of `able` that hold, from (left, right, value, seed, plain) rows.

    The graph has one edge per distinct context and string, so one that stands in a third of the corpus is aggregated before it is joined. Seeds stay believed; a further string is believed as the best context around it is, a plain one not at all. Belief only grows from turn to turn, so the turns end.
    """
    edges = places.where("value is not null").select(F.explode(F.array("left", "right")).alias("context"), "value", "seed", "plain").where("context <> 0").groupBy("context", "value").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.min("plain").alias("plain"), F.count("*").alias("n"))
    edges = cut(edges.join(able, "context", "left_semi"))
    share = lambda belief: F.sum(belief * F.col("n")) / F.sum("n")
    scored, before = cut(edges.groupBy("context").agg(share(F.col("seed")).alias("confidence"))), None
    for _ in range(turns):
        now = scored.agg(F.count("*"), F.round(F.sum("confidence"), 6), F.count_if(F.col("confidence") >= confidence)).first()
        if not now[0] or now == before:
            break
        before = now
        strings = edges.join(scored, "context").groupBy("value").agg(F.max("seed").alias("seed"), F.max(F.when(~F.col("plain"), F.col("confidence"))).alias("best"))
        strings = strings.select("value", F.greatest("seed", F.when(F.col("best") >= confidence, F.col("best")).otherwise(F.lit(0.0))).alias("belief"))
        scored = cut(edges.select("context", "value", "n").join(strings, "value").groupBy("context").agg(share(F.col("belief")).alias("confidence")))
    return scored.where(F.col("confidence") >= confidence)


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", support: int = SUPPORT, confidence: float = CONFIDENCE, turns: int = TURNS) -> DataFrame:
    """Per row: the key, base spans and learned spans, both arrays of (kind, lo, hi)."""
    able = possible_contexts(docs.select(F.col(text).alias("text")), support, confidence)
    rows = cut(extract(docs, Table(able), text, key).withColumn("row", F.monotonically_increasing_id()))
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    holds = learned_contexts(places, able, confidence, turns)
    unseen = places.where("not seed").select("row", "lo", "hi", "plain", F.col("value").isNull().alias("both"), F.explode(F.array("left", "right")).alias("context"))
    held = unseen.join(holds.select("context"), "context", "left_semi").groupBy("row", "lo", "hi", "both").agg(F.max("plain").alias("plain"), F.count_distinct("context").alias("sides"))
    # Between two contexts both must hold, and the nearest that does ends the string; a span inside another is part of it.
    two = held.where("both and sides = 2").groupBy("row", "lo").agg(F.min("hi").alias("hi"))
    one = held.where("not both and not plain").select("row", "lo", "hi")
    marked = two.select("row", "lo", "hi").union(one).groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit(LEARNED).alias("kind"), "lo", "hi"))).alias("learned"))
    inside = "exists(learned, y -> y.lo <= x.lo and x.hi <= y.hi and y.hi - y.lo > x.hi - x.lo)"
    marked = marked.withColumn("learned", F.expr(f"filter(learned, x -> not {inside})"))
    none = F.lit([]).cast("array<struct<kind string, lo int, hi int>>")
    return rows.join(marked, "row", "left").select("doc_id", "base", F.coalesce("learned", none).alias("learned"))


def query(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.lo, s.hi)), ",")
    count = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "learned")).alias("spans"), F.size("learned").cast("long").alias("n_context"))


