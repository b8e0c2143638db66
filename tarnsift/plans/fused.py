"""The scan in one Arrow stage: normal form, automaton, edges, rules, findings, a document at a time and nothing shuffled.

A document may only send its findings on if some rule's rarest slot can occur in it; that is tested before, JVM-side, so that most documents never reach Python.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Base
from ..functions.scanner import Scanner
from ..functions.text import ENTITIES, pieces
from ..operators.scan import spread

FINDINGS = "lo long, hi long, threat string, severity string, also array<string>, merged long"
_TYPE = pa.list_(pa.string())


def scan(docs: DataFrame, base: Base, mode: str = "ipi", key: str = "doc_key", text: str = "text", pad: int = 0, quoted: bool = False) -> DataFrame:
    """(key, lo, hi, threat, severity, also, merged), one row per finding. A null text counts as empty. The base travels with the plan; each worker makes one automaton of it. quoted: each row has its text too, for what is made of both without a join."""
    return _scan(spread(docs.select(key, text)), base, mode, key, text, pad, quoted)


def _scan(docs: DataFrame, base: Base, mode: str, key: str, text: str, pad: int, quoted: bool = False) -> DataFrame:
    base.active(mode)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, mode)
        for b in pieces(batches, 1):
            nth, rows = [], []
            for i, t in enumerate(b.column(1)):
                for f in scanner.findings(t.as_py() or "", pad):
                    nth.append(i)
                    rows.append(f)
            types = {"lo": pa.int64(), "hi": pa.int64(), "threat": pa.string(), "severity": pa.string(), "also": _TYPE, "merged": pa.int64()}
            whole = [b.column(c).take(pa.array(nth, pa.int64())) for c in range(1 + quoted)]
            yield pa.RecordBatch.from_arrays([whole[0], *(pa.array([r[c] for r in rows], t) for c, t in types.items()), *whole[1:]], names=[key, *types, *[text] * quoted])

    return docs.mapInArrow(run, f"`{key}` {kind}, {FINDINGS}" + f", `{text}` string" * quoted)


def gate(base: Base, mode: str, text: str = "text") -> Column:
    """True for every document that a rule may fire in. Of each rule the slot with the fewest literals must occur; where normal form or lower case could change the text, all pass."""
    by_slot = defaultdict(list)
    for slot, x in base.literals:
        by_slot[slot].append(x)
    wanted: set[str] = set()
    for r in base.active(mode):
        slots = {s for a, f, *_ in r.edges for s in (a, f)}
        lexical = [s for s in slots if s in by_slot]
        wanted.add(min(lexical, key=lambda s: (len(by_slot[s]), s)) if lexical else min(slots))
    literals = sorted({x for s in wanted for x in by_slot.get(s, ())} | {x for k, _, needs in ENTITIES if k in wanted - set(by_slot) for x in needs})
    t = F.coalesce(F.col(text), F.lit(""))
    test = t.rlike("[^\\x20-\\x7E\\n\\t\\rÀ-ÿ]|  ")
    for x in literals:
        test = F.contains(F.lower(t), F.lit(x)) | test
    return test


def scan_gated(docs: DataFrame, base: Base, mode: str = "ipi", key: str = "doc_key", text: str = "text", pad: int = 0) -> DataFrame:
    """scan() of the documents that pass the gate."""
    dealt, test = spread(docs.select(key, text)), gate(base, mode, text)
    if not docs.isStreaming:
        # Not deterministic to the planner as a whole, so it stays above the exchange, where the rows are dealt.
        test = F.when(F.monotonically_increasing_id() >= 0, test)
    return _scan(dealt.where(test), base, mode, key, text, pad)
