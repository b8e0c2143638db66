"""What the hosts of conversations and tools need: stamped answers, filtered tool output, commands, validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Base
from .findings import islands
from .guard import checked, decide, grown, replaced, turn_meta

#: Host's role, ours.
ROLES = {"human": "user", "ai": "assistant"}
WITHHELD = "[tool output withheld]"


def role(host: Column) -> Column:
    """Our name of a host's role; others stay."""
    return F.coalesce(*[F.when(host == h, F.lit(r)) for h, r in ROLES.items()], host)


def message_text(texts: Column, results: Column) -> Column:
    """What of a message is read: its text parts, then its tool results, a blank line between; tool calls are not read. Null parts are left out."""
    parts = F.concat(F.coalesce(texts, F.array().cast("array<string>")), F.coalesce(results, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")


def stamped(answers: DataFrame, turns: DataFrame, flagged: DataFrame, roles: dict[str, str], prefix: str = "guard") -> DataFrame:
    """The answers (conv_id and more) with what was found in the request they answer: request_flagged, request_threats, and messages, a map from each turn that was read to its verdict. A conversation of which nothing was read leaves its answer as it is, with nulls."""
    verdict = decide(turns, flagged, roles).where("n_read > 0").select("conv_id", F.col("flagged").alias(f"{prefix}_request_flagged"), F.col("threats").alias(f"{prefix}_request_threats"))
    read = turn_meta(turns, flagged, roles).where("meta is not null").groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", "meta")))).alias(f"{prefix}_messages"))
    return answers.join(verdict, "conv_id", "left").join(read, "conv_id", "left")


def tool_outputs(messages: DataFrame, base: Base, mode: str = "ipi", policy: str = "passthrough", tools: tuple[str, ...] | None = None, withheld: str = WITHHELD, blank: str = " ", mask: str = "", key: str = "message_id") -> DataFrame:
    """Results of tools, (key, tool, blocks array<struct<type, text>> and more), with the text blocks as the policy leaves them, each read by itself, and meta (read, flagged, action, threats). Blocks of other types and messages of tools that are not listed pass unread, with null meta. Dropped text is replaced by a note; the message stays, as its call needs an answer. Keys must differ."""
    checked(policy, blank)
    at = messages.where(_listed(F.col("tool"), tools)).select(F.struct(F.col(key).alias("message")).alias("_at"), "blocks")
    said = _verdicts(at, base, mode).select(F.col("_at.message").alias("_message"), "_verdict")
    df = messages.join(said, F.col(key) == F.col("_message"), "left")
    if policy == "fail":
        df = _failing(df, F.col("_verdict"), F.col(key).cast("string"))
    out = _told(F.col("blocks"), F.col("_verdict"), policy, withheld, blank, mask)
    meta = F.when(_listed(F.col("tool"), tools), _meta(F.col("_verdict"), policy, base))
    return df.select(*[out.alias("blocks") if c == "blocks" else F.col(c) for c in messages.columns], meta.alias("meta"))


def _listed(tool: Column, tools: tuple[str, ...] | None) -> Column:
    return F.lit(True) if tools is None else tool.isin(*tools)


def _verdicts(read: DataFrame, base: Base, mode: str) -> DataFrame:
    """(_at, _verdict struct<spans map<nth, merged blocks>, seen array<struct<nth, seen>>>) of the messages (_at, blocks) in which something was found. Texts are read once and go along with their findings, so none is joined."""
    from ..plans.fused import scan

    each = read.select("_at", F.posexplode("blocks").alias("_nth", "_block")).where("_block.type = 'text' and _block.text is not null")
    each = each.select(F.struct("_at", "_nth").alias("part"), F.col("_block.text").alias("_t"))
    rows = grown(scan(each, base, mode, "part", "_t", pad=-50, quoted=True).select("part", "lo", "hi", "threat", "_t"))
    joined = islands(rows, "part", "block_lo", "block_hi").groupBy("part", "island").agg(F.min("block_lo").alias("lo"), F.max("block_hi").alias("hi"), F.collect_list(F.struct("lo", "threat")).alias("seen"))
    parts = joined.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"))
    spans = F.map_from_entries(F.collect_list(F.struct("part._nth", "spans"))).alias("spans")
    return parts.groupBy("part._at").agg(F.struct(spans, F.array_sort(F.collect_list(F.struct("part._nth", "seen"))).alias("seen")).alias("_verdict"))


def _told(blocks: Column, verdict: Column, policy: str, withheld: str, blank: str, mask: str) -> Column:
    """The blocks as the policy leaves them."""
    fill = (lambda n: F.repeat(F.lit(blank), n)) if policy == "blank" else (lambda n: F.lit(mask))
    spans = lambda i: F.element_at(verdict["spans"], i)
    edited = lambda x, i: F.when(spans(i).isNotNull(), replaced(x["text"], spans(i), fill)).otherwise(x["text"])
    put = F.transform(blocks, lambda x, i: F.struct(x["type"].alias("type"), edited(x, i).alias("text"))) if policy in ("blank", "mask") else blocks
    gone = F.array(F.struct(F.lit("text").alias("type"), F.lit(withheld).alias("text")))
    if policy == "drop":
        return F.when(verdict.isNotNull(), gone).otherwise(blocks)
    if policy == "mask":
        # A text of which nothing is left takes its message with it.
        bare = F.exists(F.transform(put, lambda x, i: spans(i).isNotNull() & (F.regexp_replace(x["text"], r"\s+", "") == "")), lambda x: x)
        put = F.when(bare, gone).otherwise(put)
    return F.when(verdict.isNotNull(), put).otherwise(blocks)


def _meta(verdict: Column, policy: str, base: Base) -> Column:
    threats = F.array_distinct(F.flatten(F.transform(verdict["seen"], lambda x: F.transform(x["seen"], lambda y: y["threat"]))))
    hit = verdict.isNotNull()
    return F.struct(hit.alias("flagged"), F.when(hit, policy).otherwise("none").alias("action"), F.lit(base.version).alias("base"), F.when(hit, threats).alias("threats"))


def _failing(df: DataFrame, verdict: Column, name: Column) -> DataFrame:
    said = F.concat(F.lit("injection found in "), name, F.lit(":"), verdict["seen"][0]["_nth"].cast("string"))
    return df.where(F.when(verdict.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))


def commands(results: DataFrame, base: Base, mode: str = "ipi", policy: str = "passthrough", tools: tuple[str, ...] | None = None, withheld: str = WITHHELD, blank: str = " ", mask: str = "", key: str = "command_id") -> DataFrame:
    """Tools that answer with a command, (key, messages array<struct<tool, blocks>> and more): each message in it is read like a tool's own, in its place. Commands without messages stay as they are. Only verdicts are put together by command; the texts stay in their row."""
    checked(policy, blank)
    each = results.select(F.col(key).alias("_command"), F.posexplode("messages").alias("_nth", "_m")).where(_listed(F.col("_m.tool"), tools))
    said = _verdicts(each.select(F.struct(F.col("_command").alias("command"), F.col("_nth").alias("message")).alias("_at"), F.col("_m.blocks").alias("blocks")), base, mode)
    whole = said.groupBy(F.col("_at.command").alias("_command")).agg(F.map_from_entries(F.collect_list(F.struct("_at.message", "_verdict"))).alias("_verdicts"))
    df = results.join(whole, F.col(key) == F.col("_command"), "left")
    if policy == "fail":
        first = F.array_min(F.map_keys("_verdicts"))
        df = _failing(df, F.element_at("_verdicts", first), F.concat_ws("/", F.col(key).cast("string"), first.cast("string")))

    def told(m: Column, i: Column) -> Column:
        verdict = F.element_at(F.col("_verdicts"), i)
        meta = F.when(_listed(m["tool"], tools), _meta(verdict, policy, base))
        return F.struct(m["tool"].alias("tool"), _told(m["blocks"], verdict, policy, withheld, blank, mask).alias("blocks"), meta.alias("meta"))

    columns = [c for c in results.columns if c != "messages"]
    return df.select(*columns, F.transform("messages", told).alias("messages"))


def one_of_two(turns: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, blocked): every conversation's turns are in exactly one of them, by the verdict's keep; without a verdict they pass."""
    df = turns.join(verdicts.select("conv_id", "keep"), "conv_id", "left").withColumn("_pass", F.coalesce("keep", F.lit(True)))
    return df.where("_pass").select(*turns.columns), df.where("not _pass").select(*turns.columns)


def validated(turns: DataFrame, flagged: DataFrame, roles: dict[str, str], policy: str = "passthrough") -> DataFrame:
    """The turns as they came with meta, for a link of a chain: it marks or, with `fail`, stops; a link can't drop a request, so `drop` is refused."""
    if policy not in ("passthrough", "fail"):
        raise ValueError("a link of a chain passes on or fails")
    out = turn_meta(turns, flagged, roles, policy)
    if policy == "fail":
        out = out.where(F.when(F.coalesce(F.col("meta.flagged"), F.lit(False)), F.raise_error(F.concat(F.lit("injection found in conversation "), F.col("conv_id").cast("string"))).cast("boolean")).otherwise(True))
    return out
