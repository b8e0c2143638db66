"""What is done about findings: pass, blank, mask, drop or fail; for documents and for conversations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import MODES, Base
from ..functions.scanner import Scanner
from ..functions.text import pieces
from .findings import islands
from .scan import fired_in, spread

POLICIES = ("passthrough", "blank", "mask", "drop", "fail")
#: The longest block, the least length of a wrapped line, and how many lines are joined each way.
LINE_LIMIT, WRAP_WIDTH, WRAP_LINES = 1500, 40, 8


def is_wrapped(line: Column) -> Column:
    """The middle of a sentence that a wrapper broke: long, and not at an end."""
    s = F.regexp_replace(line, r"\s+$", "")
    return (F.length(s) >= WRAP_WIDTH) & s.rlike(r"[\p{L}\p{N},;:\-—]$")


def finishes(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+$", "").rlike(r"[.!?…\"')]$")


def boundary(spans: DataFrame, docs: DataFrame, key: str = "doc_key", text: str = "text", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The rows with block_lo, block_hi: the utterance around a span. Lines that a wrapper broke are joined; a block that gets too long falls back to its line, and a line that long to its sentence."""
    return grown(spans.join(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")), key), lo, hi)


def grown(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """boundary() of rows that have their text, not null, as _t, which goes."""
    t, n = F.col("_t"), F.length("_t")
    head, tail = F.substring(t, 1, F.col(lo)), F.substring(t, F.col(hi) + 1, n)
    # Lines above and below the line of the span, nearest first, without the parts on its own line.
    df = df.withColumn("_up", F.reverse(F.split(head, "\n"))).withColumn("_down", F.split(tail, "\n"))
    df = df.withColumn("_a", F.col(lo) - F.length(F.col("_up")[0])).withColumn("_b", F.col(hi) + F.length(F.col("_down")[0]))
    df = df.withColumn("_line", F.substring_index(F.substring(t, 1, F.col("_b")), "\n", -1))
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    up = F.aggregate(F.slice("_up", 2, WRAP_LINES), start, lambda acc, x: F.when(acc["on"] & is_wrapped(x), F.struct(F.lit(True).alias("on"), (acc["n"] + F.length(x) + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), acc["n"].alias("n"))), lambda acc: acc["n"])
    begin = F.struct(is_wrapped(F.col("_line")).alias("on"), F.lit(0).alias("n"))

    def below(acc: Column, x: Column) -> Column:
        joins = acc["on"] & (F.trim(F.regexp_replace(x, r"\s+", " ")) != "") & (is_wrapped(x) | finishes(x))
        return F.when(joins, F.struct(is_wrapped(x).alias("on"), (acc["n"] + F.length(x) + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), acc["n"].alias("n")))

    down = F.aggregate(F.slice("_down", 2, WRAP_LINES), begin, below, lambda acc: acc["n"])
    df = df.withColumn("_wa", F.col("_a") - up).withColumn("_wb", F.col("_b") + down)
    wide, line = F.col("_wb") - F.col("_wa") <= LINE_LIMIT, F.col("_b") - F.col("_a") <= LINE_LIMIT
    # The end of the last sentence that ends before the span, and of the first that ends after it.
    s_lo = F.length(F.regexp_extract(head, r"^[\s\S]*[.!?…](?=\s)", 0))
    ends = F.regexp_extract(tail, r"^[\s\S]*?[.!?…](?=\s|$)", 0)
    s_hi = F.when(F.length(ends) > 0, F.col(hi) + F.length(ends)).otherwise(n)
    pick = lambda w, x, s: F.when(wide, w).when(line, x).otherwise(s).cast("int")
    return df.withColumn("block_lo", pick(F.col("_wa"), F.col("_a"), s_lo)).withColumn("block_hi", pick(F.col("_wb"), F.col("_b"), s_hi)).drop("_t", "_up", "_down", "_a", "_b", "_line", "_wa", "_wb")


#: What JVM-side patterns take for blanks, and for an end of line besides them.
_BLANKS, _ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"
_STOP, _LAST_STOP = re.compile(rf"[.!?…](?=[{_BLANKS}])"), re.compile(rf"[.!?…](?=[{_BLANKS}]|[{_ENDS}]?\Z)")


def _stripped(line: str) -> tuple[str, str]:
    """The line without blanks at its end, and its last character; an end of line may stand behind both."""
    s = line[:-1].rstrip(_BLANKS) + line[-1:] if line[-1:] and line[-1] in _ENDS else line.rstrip(_BLANKS)
    return s, s[-2:-1] if s and s[-1] in _ENDS else s[-1:]


def _wrapped(line: str) -> bool:
    s, c = _stripped(line)
    return len(s) >= WRAP_WIDTH and c != "" and (c in ",;:-—" or unicodedata.category(c)[0] in "LN")


def utterance(text: str, lo: int, hi: int) -> tuple[int, int]:
    """grown() of one span, in Python."""
    up, down = text[:lo].rsplit("\n", WRAP_LINES + 1)[::-1], text[hi:].split("\n", WRAP_LINES + 1)
    a, b = lo - len(up[0]), hi + len(down[0])
    wa, wb = a, b
    for x in up[1 : WRAP_LINES + 1]:
        if not _wrapped(x):
            break
        wa -= len(x) + 1
    on = _wrapped(text[text.rfind("\n", 0, b) + 1 : b])
    for x in down[1 : WRAP_LINES + 1]:
        c = _stripped(x)[1]
        wraps = _wrapped(x)
        if not on or not x.strip(_BLANKS) or not (wraps or (c and c in ".!?…\"')")):
            break
        wb, on = wb + len(x) + 1, wraps
    if wb - wa <= LINE_LIMIT:
        return wa, wb
    if b - a <= LINE_LIMIT:
        return a, b
    s_lo, end = 0, _LAST_STOP.search(text, hi)
    for m in _STOP.finditer(text, 0, lo):
        s_lo = m.end()
    return s_lo, end.end() if end else len(text)


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """blocks() of the spans of one document."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def blocked(docs: DataFrame, base: Base, mode: str = "ipi", text: str = "text", name: str = "spans") -> DataFrame:
    """The documents with their merged blocks, array<struct<lo,hi>>, null where no rule fires: what fired() finds in the text as it is, merged at its raw extent, grown, merged again. All is made where the text stands, in one Arrow stage; keys may repeat."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {name}; give another name")
    base.active(mode)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, mode)
        for b in pieces(batches, at):
            made = []
            for x in b.column(at):
                t = x.as_py() or ""
                fired = fired_in(scanner, t)
                found = scanner.merged(t, fired, range(len(t)), -50) if fired else []
                made.append([{"lo": lo, "hi": hi} for lo, hi in joined(utterance(t, f["lo"], f["hi"]) for f in found)] or None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=[*b.schema.names, name])

    return spread(docs).mapInArrow(run, f"{fields}, `{name}` array<struct<lo:int,hi:int>>")


def blocks(spans: DataFrame, key: str = "doc_key", lo: str = "block_lo", hi: str = "block_hi") -> DataFrame:
    """(key, spans array<struct<lo,hi>>) of merged blocks by lo."""
    joined = islands(spans.select(key, lo, hi), key, lo, hi).groupBy(key, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def replaced(text: Column, spans: Column, fill) -> Column:
    """The text with each span replaced by fill(length)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["hi"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["lo"] - acc["at"]), fill(s["hi"] - s["lo"])).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def checked(policy: str, blank: str) -> None:
    if policy not in POLICIES or len(blank) != 1:
        raise ValueError(f"policy is one of {POLICIES}, blank one character")


OUTPUTS = ("keep", "flagged", "policy", "removed")


def apply(docs: DataFrame, found: DataFrame, policy: str = "passthrough", blank: str = " ", mask: str = "", key: str = "doc_key", text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with text as the policy leaves it, and keep, flagged, policy, removed, each under the prefix. found: (key, spans) of merged blocks.

    A text without a block stays as it is, null too. Columns of these names are refused, rather than lost. With `fail`, whatever is done with the result stops at the first flagged document.
    """
    some = found.select(F.col(key).alias("_guard_key"), F.col("spans").alias("_guard_spans"))
    df = docs.join(some, F.col(key).eqNullSafe(F.col("_guard_key")), "left").drop("_guard_key")
    return edited(df, "_guard_spans", policy, blank, mask, key, text, prefix)


def edited(df: DataFrame, spans: str = "spans", policy: str = "passthrough", blank: str = " ", mask: str = "", key: str = "doc_key", text: str = "text", prefix: str = "") -> DataFrame:
    """apply() of documents that have their merged blocks, as blocked() gives them, in a column, which goes."""
    checked(policy, blank)
    kept = [c for c in df.columns if c != spans]
    names = {c: prefix + c for c in OUTPUTS}
    if clash := {c.lower() for c in kept} & {c.lower() for c in names.values()}:
        raise ValueError(f"the documents have columns {sorted(clash)}; name another prefix")
    spans = F.col(spans)
    flagged, t = spans.isNotNull(), F.coalesce(F.col(text), F.lit(""))
    if policy == "fail":
        # As a filter it can't be pruned away, as an unread column would be.
        df = df.where(F.when(flagged, F.raise_error(F.concat(F.lit("injection found in "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    fill = (lambda n: F.repeat(F.lit(blank), n)) if policy == "blank" else (lambda n: F.lit(mask))
    edits = policy in ("blank", "mask")
    out = F.when(flagged, replaced(t, spans, fill)).otherwise(F.col(text)) if edits else F.col(text)
    df = df.withColumn("_guard_out", out)
    left = F.regexp_replace("_guard_out", r"\s+", "") != ""
    keep = ~flagged if policy == "drop" else (~flagged | left) if policy == "mask" else F.lit(True)
    total = F.coalesce(F.aggregate(spans, F.lit(0), lambda acc, x: acc + x["hi"] - x["lo"]), F.lit(0)) if edits else F.lit(0)
    columns = [F.col("_guard_out").alias(c) if c == text else F.col(c) for c in kept]
    return df.select(*columns, keep.alias(names["keep"]), flagged.alias(names["flagged"]), F.lit(policy).alias(names["policy"]), total.alias(names["removed"]))


def guarded(docs: DataFrame, base: Base, mode: str = "ipi", policy: str = "passthrough", blank: str = " ", mask: str = "", key: str = "doc_key", text: str = "text", prefix: str = "") -> DataFrame:
    """apply() of what the base finds: merged findings at their raw extent, each grown to its utterance, blocks merged again. Adds a metadata column, see metadata(). Keys must differ."""
    from ..plans.fused import scan

    found = scan(docs, base, mode, key, text, pad=-50)
    found_in = boundary(found.select(key, "lo", "hi"), docs.select(key, text), key, text)
    out = apply(docs, blocks(found_in, key), policy, blank, mask, key, text, prefix)
    return metadata(out, found, base.version, key, prefix)


def metadata(out: DataFrame, findings: DataFrame, version: str, key: str = "doc_key", prefix: str = "") -> DataFrame:
    """out of apply() with a column meta: flagged, action (none where nothing was found) and base always; threats in order of appearance, spans and removed_chars where something was."""
    seen = F.array_sort(F.collect_list(F.struct("lo", "hi", "threat")))
    g = findings.groupBy(F.col(key).alias("_meta_key")).agg(seen.alias("_meta_seen"))
    df = out.join(g, F.col(key).eqNullSafe(F.col("_meta_key")), "left")
    flagged = F.col(f"{prefix}flagged")
    meta = F.struct(
        flagged.alias("flagged"),
        F.when(flagged, F.col(f"{prefix}policy")).otherwise("none").alias("action"),
        F.lit(version).alias("base"),
        F.array_distinct(F.transform("_meta_seen", lambda x: x["threat"])).alias("threats"),
        F.transform("_meta_seen", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("spans"),
        F.when(flagged, F.col(f"{prefix}removed")).alias("removed_chars"),
    )
    return df.select(*out.columns, meta.alias(f"{prefix}meta"))


def split(out: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of apply()."""
    return out.where(F.col(f"{prefix}keep")), out.where(~F.col(f"{prefix}keep"))


def decide(turns: DataFrame, flagged: DataFrame, roles: dict[str, str], policy: str = "passthrough") -> DataFrame:
    """(conv_id, n_read, flagged, keep, threats): one verdict per conversation. flagged: (conv_id, turn, mode, perhaps threats) of turns with findings; a turn is read by the rules of its role, an empty one not at all. threats: those of the turns in order, each once."""
    if policy not in ("passthrough", "drop", "fail"):
        raise ValueError("turns are not edited")
    if unknown := set(roles.values()) - set(MODES):
        raise ValueError(f"rulesets {sorted(unknown)} are none of {MODES}")
    mode = F.coalesce(*[F.when(F.col("role") == r, F.lit(m)) for r, m in roles.items()], F.lit(None).cast("string"))
    read = turns.withColumn("mode", F.when(F.coalesce(F.col("text"), F.lit("")) != "", mode))
    named = F.col("threats") if "threats" in flagged.columns else F.lit([]).cast("array<string>")
    some = flagged.select("conv_id", "turn", "mode", named.alias("threats")).dropDuplicates(["conv_id", "turn", "mode"]).withColumn("hit", F.lit(True))
    hit = read.select("conv_id", "turn", "mode").join(some, ["conv_id", "turn", "mode"], "left")
    seen = F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("turn", "threats"))))
    g = hit.groupBy("conv_id").agg(F.count("mode").alias("n_read"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("flagged"), F.array_distinct(F.flatten(F.transform(seen, lambda x: x["threats"]))).alias("threats"))
    if policy == "fail":
        g = g.where(F.when(F.col("flagged"), F.raise_error(F.concat(F.lit("injection found in conversation "), F.col("conv_id").cast("string"))).cast("boolean")).otherwise(True))
    return g.select("conv_id", "n_read", "flagged", (~(F.col("flagged") & F.lit(policy == "drop"))).alias("keep"), "threats")


def turn_meta(turns: DataFrame, flagged: DataFrame, roles: dict[str, str], policy: str = "passthrough", version: str = "") -> DataFrame:
    """The turns with meta (flagged, action, base, threats); null for a turn that no ruleset reads, which says something else than nothing found."""
    mode = F.coalesce(*[F.when(F.col("role") == r, F.lit(m)) for r, m in roles.items()], F.lit(None).cast("string"))
    named = F.col("threats") if "threats" in flagged.columns else F.lit(None).cast("array<string>")
    some = flagged.select("conv_id", "turn", F.col("mode").alias("_mode"), named.alias("_threats")).dropDuplicates(["conv_id", "turn", "_mode"])
    df = turns.withColumn("_mode", F.when(F.coalesce(F.col("text"), F.lit("")) != "", mode)).join(some.withColumn("_hit", F.lit(True)), ["conv_id", "turn", "_mode"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    meta = F.struct(hit.alias("flagged"), F.when(hit, policy).otherwise("none").alias("action"), F.lit(version).alias("base"), F.when(hit, F.col("_threats")).alias("threats"))
    return df.select(*[F.col(c) for c in turns.columns], F.when(F.col("_mode").isNotNull(), meta).alias("meta"))


def since_assistant(turns: DataFrame) -> DataFrame:
    """Turns after the last one of the assistant."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return turns.withColumn("_last", F.coalesce(last, F.lit(-1))).where("turn > _last").drop("_last")


def forget(turns: DataFrame, flagged: DataFrame, refusal: str) -> DataFrame:
    """The conversations without their flagged turns, and with the refusal as the last turn of each that had one."""
    kept = turns.join(flagged.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti")
    said = turns.join(flagged.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("assistant").alias("role"), F.lit(refusal).alias("text"))
    return kept.select("conv_id", "turn", "role", "text").unionByName(said)
