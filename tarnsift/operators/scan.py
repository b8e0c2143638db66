"""Hits, edges and fired rules, in columns.

Everything up to the edges stays within a document's row, so no text is shuffled; what is grouped by document afterwards are the few edges that some rule names. Hits come from one Arrow stage, as Spark has no search for many literals at once; the planner also can't write that stage out twice, as it does with large expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import Base
from ..functions.scanner import SPAN_BASE, WINDOW, Scanner, pairs, unmasked
from ..functions.text import FOLDED, PARAGRAPH, lowered, pieces, spans

_TOKENS, _BREAKS = re.compile(r"[^\W\d_]+|\d+"), re.compile(PARAGRAPH)
_HIT = "array<struct<lo:int,hi:int,slot:string>>"
#: Edges that Python holds at a time.
EDGE_ROWS = 10_000
#: Counted contexts that Python holds before it sends them on.
CONTEXT_ROWS = 50_000
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def literal_hits(low: Column, base: Base) -> Column:
    """array<struct<lo,hi,slot>> of whole-word literals, also overlapping ones. A literal is searched by pattern only where it occurs at all."""
    by_literal: dict[str, list[str]] = {}
    for slot, x in base.literals:
        by_literal.setdefault(x, []).append(slot)
    each = []
    for x, slots in by_literal.items():
        pattern = (_EDGE if x[0].isalnum() else "") + "".join("\\" + c if not c.isalnum() and c != " " and c != "_" else c for c in x) + (_END if x[-1].isalnum() else "")
        named = F.flatten(F.transform(spans(low, pattern), lambda m: F.transform(F.array(*map(F.lit, slots)), lambda s: F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), s.alias("slot")))))  # noqa: B023
        each.append(F.when(F.contains(low, F.lit(x)), named).otherwise(F.lit([]).cast(_HIT)))
    return F.concat(*each)


def spread(docs: DataFrame) -> DataFrame:
    """Rows of few files are dealt over all cores, since scanning costs far more than moving them. Tables of more files than cores stay as they are."""
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def _read(scanner: Scanner, low: str) -> tuple[list[tuple[int, int, str]], str]:
    """The hits of a lower-cased text, and it with its entities folded."""
    found, ents = scanner.hits(low)
    parts, at = [], 0
    for x, y in scanner.folds(ents):
        parts += [low[at:x], FOLDED * (y - x)]
        at = y
    return found, "".join([*parts, low[at:]])


def _paired(hits: list[tuple[int, int, str]], masked: str) -> Iterator[tuple]:
    tokens = [(*m.span(), "<entity>" if m.group()[0] == FOLDED else m.group()) for m in _TOKENS.finditer(masked)]
    return pairs(hits, tokens, [m.start() for m in _BREAKS.finditer(masked)])


def fired_in(scanner: Scanner, text: str) -> list[tuple]:
    """What fired() finds in one text: (rule, hull, lo, hi)."""
    low = lowered(text)
    if not scanner.possible(low):
        return []
    found = defaultdict(list)
    for *e, lo, hi, _ in _paired(*_read(scanner, low)):
        if (k := tuple(e)) in scanner.needed or k in scanner.refuting:
            found[k].append((lo, hi))
    return scanner.fired(low, found)


_EDGE_NAMES, _EDGE_TYPES = ("anchor", "filler", "dist", "conn", "lo", "hi", "at"), (*[pa.string()] * 4, *[pa.int32()] * 3)
_EDGE_COLUMNS = "anchor string, filler string, dist string, conn string, lo int, hi int, at int"


def _edge_batches(b: pa.RecordBatch, key: str, found: Iterator[tuple[int, Iterator[tuple]]]) -> Iterator[pa.RecordBatch]:
    """Rows of edges from (row of b, its edges), some thousands to a batch."""
    nth, made = [], []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [()] * len(_EDGE_NAMES)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(nth, pa.int64())), *map(pa.array, columns, _EDGE_TYPES)], names=[key, *_EDGE_NAMES])

    for i, some in found:
        for edge in some:
            nth.append(i)
            made.append(edge)
            if len(made) >= EDGE_ROWS:
                yield batch()
                nth, made = [], []
    if made:
        yield batch()


def with_hits(docs: DataFrame, base: Base, text: str = "text", key: str = "doc_key") -> DataFrame:
    """(key, hits array<struct<lo,hi,slot>> by lo, hi, slot; masked, the lower-cased text with its entities folded).

    An entity is one term: literals within it are none. Of hits of a slot on the same words the longest stays. A null text counts as empty.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base)
        types = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("slot", pa.string())]))
        for b in pieces(batches, 1):
            hits, masked = [], []
            for t in b.column(1):
                found, folded = _read(scanner, lowered(t.as_py() or ""))
                hits.append([{"lo": x, "hi": y, "slot": s} for x, y, s in found])
                masked.append(folded)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, types), pa.array(masked, pa.string())], names=[key, "hits", "masked"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, hits array<struct<lo:int,hi:int,slot:string>>, masked string")


def edges(rows: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, anchor, filler, dist, conn, lo, hi, at), one row per occurrence, from with_hits(); at is where the right hit begins. Each pair is made once, from left to right, in the document's own row: nothing is shuffled, and only neighbours are paired."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            read = enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            yield from _edge_batches(b, key, ((i, _paired([(h["lo"], h["hi"], h["slot"]) for h in hits], masked)) for i, (hits, masked) in read))

    some = rows.where(F.size("hits") > 1).select(key, "hits", "masked")
    return some.mapInArrow(run, f"`{key}` {kind}, {_EDGE_COLUMNS}")


def text_edges(docs: DataFrame, base: Base, key: str = "doc_key", text: str = "text", mode: str | None = None, whole: bool = False) -> DataFrame:
    """edges() of with_hits() in one Arrow stage, which sends on no text. With a mode only edges that one of its rules, or a refutation, names; whole: and only of documents that hold all edges of some rule, as no rule fires in others."""
    kind = docs.schema[key].dataType.simpleString()
    if whole and mode is None:
        raise ValueError("whole rules are those of a mode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, mode)
        slots = [{s for a, f, *_ in r.edges for s in (a, f)} for r in scanner.rules]

        def found(b: pa.RecordBatch) -> Iterator[tuple[int, Iterator[tuple]]]:
            for i, t in enumerate(b.column(1)):
                low = lowered(t.as_py() or "")
                if whole and not scanner.possible(low):
                    continue
                hits, masked = _read(scanner, low)
                if len(hits) < 2 or (whole and not any(s <= {h[2] for h in hits} for s in slots)):
                    continue
                some = _paired(hits, masked)
                if mode is not None:
                    some = (e for e in some if e[:4] in scanner.needed or e[:4] in scanner.refuting)
                if whole:
                    some = list(some)
                    have = {e[:4] for e in some}
                    if not any(have.issuperset(r.edges) for r in scanner.rules):
                        continue
                yield i, some

        for b in pieces(batches, 1):
            yield from _edge_batches(b, key, found(b))

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, {_EDGE_COLUMNS}")


def in_region(found: DataFrame, regions: DataFrame, key: str = "doc_key") -> DataFrame:
    """The edges of which one end begins in the document's region (key, region_lo, region_hi); documents without one have none."""
    both = found.join(regions.select(key, "region_lo", "region_hi"), key)
    inside = lambda c: (F.col(c) >= F.col("region_lo")) & (F.col(c) < F.col("region_hi"))
    return both.where(inside("lo") | inside("at")).select(*found.columns)


def contexts(rows: DataFrame, key: str = "doc_key") -> DataFrame:
    """(slot, token, side, dist, n): the unmasked tokens within WINDOW of a hit on both sides, up to a paragraph's end, counted over all rows of with_hits(). Tokens of hits are passed over and do not count as distance."""

    def batch(seen: Counter) -> pa.RecordBatch:
        columns = [[k[i] for k in seen] for i in range(4)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(seen.values()), pa.int64())], names=["slot", "token", "side", "dist", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in pieces(batches, 1):
            for hits, masked in zip(b.column("hits").to_pylist(), b.column("masked").to_pylist(), strict=True):
                tokens = [m.span() for m in _TOKENS.finditer(masked)]
                begins, breaks = [a for a, _ in tokens], [m.start() for m in _BREAKS.finditer(masked)]
                free = unmasked(tokens, sorted((h["lo"], h["hi"]) for h in hits))
                for h in hits:
                    for side, near in (("L", range(bisect_left(begins, h["lo"]) - 1, -1, -1)), ("R", range(bisect_left(begins, h["hi"]), len(tokens)))):
                        # The tokens in reach are counted before those of hits are passed over.
                        d = 0
                        for k in islice(near, WINDOW):
                            if not free[k]:
                                continue
                            lo, hi = tokens[k]
                            a, z = (hi, h["lo"]) if side == "L" else (h["hi"], lo)
                            if bisect_left(breaks, a) != bisect_left(breaks, z):
                                break
                            d += 1
                            word = "<entity>" if masked[lo] == FOLDED else masked[lo:hi]
                            seen[h["slot"], word, side, str(d) if d <= 3 else "4-5" if d <= 5 else "6-8"] += 1
            if len(seen) >= CONTEXT_ROWS:
                yield batch(seen)
                seen.clear()
        yield batch(seen)

    counted = rows.select("hits", "masked").mapInArrow(run, "slot string, token string, side string, dist string, n long")
    return counted.groupBy("slot", "token", "side", "dist").agg(F.sum("n").alias("n"))


def probe(docs: DataFrame, base: Base, mode: str = "ipi", key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, rule, placements, hull, begins, first, para_len, paras, lines) of each rule whose edges all occur, whatever its aperture: how many placements, the tightest one's width and beginning, which edge begins first in it, how long its paragraph is, and over how few paragraph and line ends some placement reaches."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["rule", "placements", "hull", "begins", "first", "para_len", "paras", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, mode)
        for b in pieces(batches, 1):
            rows = [(k.as_py(), *r) for k, t in zip(b.column(0), b.column(1), strict=True) for r in scanner.probed(t.as_py() or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[key, *names])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names))


def needed(found: DataFrame, base: Base, mode: str) -> DataFrame:
    """Edges that some active rule names, with rule and edge_no."""
    return found.join(F.broadcast(base.edges_table(found.sparkSession, mode)), ["anchor", "filler", "dist", "conn"])


def refuted(found: DataFrame, base: Base, mode: str, key: str = "doc_key") -> DataFrame:
    """(key, mass) of documents whose distinct refuting edges reach the mode's threshold."""
    least = dict(base.thresholds).get(mode)
    weighed = found.join(F.broadcast(base.refuting_table(found.sparkSession)), ["anchor", "filler", "dist", "conn"]).select(key, "anchor", "filler", "dist", "conn", "weight").distinct()
    return weighed.groupBy(key).agg(F.sum("weight").alias("mass")).where(F.lit(False) if least is None else F.col("mass") >= least)


def placements(named: DataFrame, base: Base, mode: str, key: str = "doc_key") -> DataFrame:
    """(key, rule, hull, lo, hi, edge_spans): of each rule with all its edges, the tightest placement. Equal widths: the one that begins last; for an edge, the least end, then the latest beginning."""
    return _tightest(named.groupBy(key, "rule", "edge_no").agg(F.collect_set(F.struct("lo", "hi")).alias("at")), base, mode, key)


def _tightest(sides: DataFrame, base: Base, mode: str, key: str) -> DataFrame:
    n = base.rules_table(sides.sparkSession, mode).select("rule", "n_edges")
    whole = sides.groupBy(key, "rule").agg(F.sort_array(F.collect_list(F.struct("edge_no", "at"))).alias("sides")).join(F.broadcast(n), "rule").where(F.size("sides") == F.col("n_edges"))
    # For each left border that some occurrence gives: per edge the best occurrence from there on.
    borders = F.array_distinct(F.flatten(F.transform("sides", lambda s: F.transform(s["at"], lambda o: o["lo"]))))

    def at(left: Column) -> Column:
        best = lambda s: F.array_min(F.transform(F.filter(s["at"], lambda o: o["lo"] >= left), lambda o: F.struct(o["hi"].alias("hi"), (-o["lo"]).alias("neg"))))
        picked = F.transform("sides", best)
        end, start = F.array_max(F.transform(picked, lambda p: p["hi"])), F.array_min(F.transform(picked, lambda p: -p["neg"]))
        return F.when(~F.exists(picked, lambda p: p.isNull()), F.struct((end - start).alias("hull"), (-start).alias("neg"), start.alias("lo"), end.alias("hi"), F.transform(picked, lambda p: F.struct((-p["neg"]).alias("lo"), p["hi"].alias("hi"))).alias("edge_spans")))

    best = F.array_min(F.filter(F.transform(borders, at), lambda p: p.isNotNull()))
    return whole.withColumn("best", best).select(key, "rule", "best.hull", "best.lo", "best.hi", "best.edge_spans")


def fired(found: DataFrame, docs: DataFrame, base: Base, mode: str, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, rule, threat, severity, hull, lo, hi, edge_spans) of the rules that fire.

    found is read once: edges of rules and refuting ones are picked by one join, and all that follows is grouped by document. docs is read again only for rules with an aperture relative to their paragraph.
    """
    spark = found.sparkSession
    least = dict(base.thresholds).get(mode)
    none = F.lit(None).cast("double").alias("weight")
    wanted = base.edges_table(spark, mode).withColumn("weight", none)
    if least is not None:
        wanted = wanted.unionByName(base.refuting_table(spark).withColumn("rule", F.lit(-1)))
    named = found.join(F.broadcast(wanted), ["anchor", "filler", "dist", "conn"]).repartition(key)
    sides = named.groupBy(key, "rule", "edge_no").agg(F.collect_set(F.struct("lo", "hi")).alias("at"), F.max("weight").alias("weight"))
    if least is not None:
        mass = F.coalesce(F.sum("weight").over(Window.partitionBy(key)), F.lit(0.0))
        sides = sides.withColumn("mass", mass).where((F.col("mass") < least) & (F.col("rule") >= 0))
    rules = F.broadcast(base.rules_table(spark, mode).select("rule", "threat", "severity", "aperture", "aperture_frac"))
    placed = _tightest(sides, base, mode, key).join(rules, "rule").where("aperture is null or hull <= aperture")
    columns = [key, "rule", "threat", "severity", "hull", "lo", "hi", "edge_spans"]
    if all(r.aperture_frac is None for r in base.active(mode)):
        return placed.select(columns)
    t = F.coalesce(F.col(text), F.lit(""))
    breaks = docs.select(key, F.length(t).alias("n"), F.transform(spans(t, r"\n[ \t]*\n"), lambda m: m["lo"]).alias("breaks"))
    both = placed.join(breaks, key)
    left = F.coalesce(F.array_max(F.filter("breaks", lambda b: b <= F.col("lo"))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter("breaks", lambda b: b > F.col("lo"))), F.col("n"))
    return both.where(F.col("aperture_frac").isNull() | (F.col("hull") <= F.col("aperture_frac") * F.greatest(F.lit(1), right - left))).select(columns)


def shown(rows: DataFrame, docs: DataFrame, pad: int = 0, key: str = "doc_key", text: str = "text") -> DataFrame:
    """The rows with span_lo, span_hi: grown, kept within the text, then to the edges of words."""
    grow = max(-SPAN_BASE, pad) + SPAN_BASE
    df = rows.join(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key)
    a, b = F.greatest(F.lit(0), F.col("lo") - grow), F.least(F.length("_text"), F.col("hi") + grow)
    df = df.withColumn("a", a).withColumn("b", b)
    word = r"[\p{L}\p{N}_]"
    before, after = F.substring("_text", 1, F.col("a")), F.substring("_text", F.col("b") + 1, F.length("_text"))
    at = lambda i: F.substring(F.col("_text"), i, 1)
    left = F.when(at(F.col("a") + 1).rlike(word) & (F.col("a") > 0), F.length(F.regexp_extract(F.reverse(before), "^" + word + "+", 0))).otherwise(0)
    right = F.when(at(F.col("b")).rlike(word) & (F.col("b") > 0), F.length(F.regexp_extract(after, "^" + word + "+", 0))).otherwise(0)
    return df.withColumn("span_lo", (F.col("a") - left).cast("int")).withColumn("span_hi", (F.col("b") + right).cast("int")).drop("a", "b", "_text")
