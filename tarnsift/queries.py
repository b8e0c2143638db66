"""The registered queries over the operators, one for each row of the inventory that gives a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .base import inflected, load, newest
from .functions import text as T
from .operators import dialogue as D
from .operators import findings as FI
from .operators import guard as G
from .operators import measure as M
from .operators import scan as S
from .operators import templates as TE
from .plans import fixtures as X
from .plans import fused

KEY = "doc_key"
LONGS = ("int", "smallint")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long") if k in LONGS else F.col(c) for c, k in df.dtypes])


def _md5(c: str = "text") -> F.Column:
    return F.md5(F.col(c).cast("binary")).alias("text_md5")


def _corpus(spark, d, injected=X.PLAIN) -> DataFrame:
    return X.planted(_t(spark, d, "documents"), injected)


def _documents(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias(KEY), "text")


def _pages(spark, d) -> DataFrame:
    return _t(spark, d, "pages").select(F.col("page_id").alias(KEY), F.col("html").alias("text"))


def planted_corpus(spark, d):
    return _corpus(spark, d).select(KEY, _md5(), "label", "payload_id", "mode", "action", "form", "inj_lo", "inj_hi")


def planted_dialogue(spark, d):
    return X.planted_turns(_t(spark, d, "conversations")).select("conv_id", "turn", "role", _md5(), "attack")


def norm_hygiene(spark, d):
    c = _corpus(spark, d, X.HIDDEN).withColumn("text", T.hygiene(F.col("text")))
    return c.select(KEY, _md5(), F.length("text").cast("long").alias("n"))


def norm_homoglyph(spark, d):
    w = T.located(_corpus(spark, d, X.HIDDEN), KEY, "text", T.WORD)
    return _long(w.where(F.col("token").rlike("[A-Za-z]") & F.col("token").rlike(f"[{T.LOOKALIKE}]")).select(KEY, "lo", "hi", "token", T.unmasked(F.col("token")).alias("latin")))


def norm_nfkc(spark, d):
    n = T.normalized(S.spread(_corpus(spark, d, X.HIDDEN).select(KEY, "text", "form")))
    return n.select(KEY, "form", F.md5(F.col("ntext").cast("binary")).alias("ntext_md5"), F.size("src").alias("n_src"))


def norm_map_violations(spark, d):
    """How many texts were checked, and in how many the offset map is not as long as the text, falls or leaves it, or the normal form is not its own. There must be none of the latter."""
    n = T.map_checks(S.spread(_corpus(spark, d, X.HIDDEN).select("text")))
    return n.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("checked", "violations")])


def tokens_offsets(spark, d):
    t = T.tallied(_documents(spark, d).withColumn("low", F.lower("text")), KEY, "low", T.TOKEN)
    return t.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in ("n", "sum_lo", "sum_hi")], F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def word_offsets(spark, d):
    t = T.tallied(_documents(spark, d).withColumn("low", F.lower("text")), KEY, "low", T.WORD)
    return t.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in ("n", "sum_lo")], F.max("end_hi").alias("end_hi"))


def paragraphs(spark, d):
    c = _corpus(spark, d).select(KEY, F.posexplode(T.spans(F.col("text"), T.PARAGRAPH)).alias("nth", "x"))
    return _long(c.select(KEY, (F.col("nth") + 1).alias("nth"), "x.lo", "x.hi"))


def _entities(df: DataFrame, low: bool = True) -> DataFrame:
    return T.entities(S.spread(df.select(KEY, "text")), KEY, low=low)


def _entity(kind: str):
    def query(spark, d):
        return _entities(_corpus(spark, d)).where(F.col("kind") == kind).select(KEY, "lo", "hi", "value")

    return query


def entities_pages(spark, d):
    return _entities(_pages(spark, d)).select(KEY, "lo", "hi", "kind", "value")


def entities_raw(spark, d):
    return _entities(_documents(spark, d), low=False).select(KEY, "lo", "hi", "kind", "value")


def entity_domains(spark, d):
    return _entities(_pages(spark, d)).groupBy("kind", "domain").agg(F.count("*").alias("n"))


def entity_novelty(spark, d):
    return _entities(_pages(spark, d)).select(KEY, "lo", "hi", "kind", "novel", "domain_novel")


def _hits(spark, d, source=None) -> DataFrame:
    return S.with_hits(_corpus(spark, d) if source is None else source, load())


def literal_hits(spark, d):
    c = _corpus(spark, d).select(KEY, F.lower("text").alias("low"))
    return _long(c.select(KEY, F.inline(S.literal_hits(F.col("low"), load())))).select(KEY, "slot", "lo", "hi")


def hits_atomic(spark, d):
    return _long(_hits(spark, d).select(KEY, F.inline("hits"))).select(KEY, "slot", "lo", "hi")


def slot_frequency(spark, d):
    return _hits(spark, d).select(KEY, F.inline("hits")).groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct(KEY).alias("docs"))


def context_counts(spark, d):
    """Tokens within eight of a hit, on both sides and by distance; what was seen once is left out."""
    return S.contexts(_hits(spark, d)).where("n >= 2")


def half_word_positions(spark, d):
    return TE.positions(S.spread(_corpus(spark, d).select(KEY, "text")), load()).select(KEY, "slot", "lo", "hi", "first", "last")


#: Templates of one to three steps, across lines or not.
TEMPLATES = (("{CANCEL_VERB} ~3 {PRIOR_REF}", False), ("{SEND_VERB} ~9 {EXTERNAL_ADDR}", False), ("please ~2 {CANCEL_VERB} ~4 guidance", False), ("{FOLLOW_VERB}", False), ("{SEND_VERB} ~9 {EXTERNAL_ADDR}", True))


def template_fragments(spark, d):
    return TE.fragments(S.spread(_corpus(spark, d).select(KEY, "text")), load(), list(TEMPLATES)).select(KEY, "template", "lo", "hi", "words")


def _edges(spark, d, source=None, mode=None, whole=False) -> DataFrame:
    return S.text_edges(_corpus(spark, d) if source is None else source, load(), KEY, mode=mode, whole=whole)


def edges_canonical(spark, d):
    return _long(_edges(spark, d).drop("at"))


def edges_in_region(spark, d):
    """Edges of which an end begins in the planted sentence."""
    docs = _corpus(spark, d)
    regions = docs.where("inj_lo is not null").select(KEY, F.col("inj_lo").alias("region_lo"), F.col("inj_hi").alias("region_hi"))
    return _long(S.in_region(_edges(spark, d, docs), regions).drop("at"))


def edge_connectives(spark, d):
    return _edges(spark, d).groupBy("anchor", "filler", "dist", "conn").agg(F.count("*").alias("n"))


def edges_pruned(spark, d):
    return edge_connectives(spark, d).where("n >= 2")


def edges_needed(spark, d):
    return _long(S.needed(_edges(spark, d, mode="ipi"), load(), "ipi").select(KEY, "rule", "edge_no", "lo", "hi").distinct())


def _fired(spark, d, mode="ipi", source=None) -> DataFrame:
    docs = _corpus(spark, d) if source is None else source
    return S.fired(_edges(spark, d, docs, mode, whole=True), docs, load(), mode)


def _rules_fired(mode: str):
    def query(spark, d):
        return _long(_fired(spark, d, mode).drop("edge_spans"))

    return query


def rule_min_hull(spark, d):
    return _long(S.placements(S.needed(_edges(spark, d, mode="ipi", whole=True), load(), "ipi"), load(), "ipi").select(KEY, "rule", "hull", "lo", "hi"))


def rule_refutation(spark, d):
    return S.refuted(_edges(spark, d, mode="ipi"), load(), "ipi")


def probe_geometry(spark, d):
    return S.probe(_corpus(spark, d), load()).select(KEY, "rule", "placements", "hull", "begins", "para_len", "paras", "lines")


def rule_evidence(spark, d):
    """Each edge of each fired rule with its quote."""
    docs = _corpus(spark, d)
    f = _fired(spark, d, "ipi", docs).select(KEY, "rule", F.posexplode("edge_spans").alias("edge_no", "at"))
    f = f.join(docs.select(KEY, "text"), KEY)
    return _long(f.select(KEY, "rule", "edge_no", "at.lo", "at.hi", F.substring(F.col("text"), F.col("at.lo") + 1, F.col("at.hi") - F.col("at.lo")).alias("quote")))


def _shown(spark, d, pad=0, mode="ipi", source=None) -> DataFrame:
    docs = _corpus(spark, d) if source is None else source
    return S.shown(_fired(spark, d, mode, docs), docs, pad)


def spans_padded(spark, d):
    return _long(_shown(spark, d).select(KEY, "rule", "span_lo", "span_hi"))


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def findings_merged(spark, d):
    m = FI.merged(_shown(spark, d)).withColumn("refs", F.array_sort(F.col("refs").cast("array<string>")))
    return _long(m.select(KEY, "island", "lo", "hi", "threat", "severity", _joined("also"), _joined("refs"), "merged"))


def _reports(spark, d) -> DataFrame:
    docs = _corpus(spark, d)
    return FI.reports(docs, FI.merged(_shown(spark, d, source=docs)))


def report_docs(spark, d):
    return _long(_reports(spark, d).withColumn("threats", F.array_join("threats", ",")))


def report_totals(spark, d):
    return _reports(spark, d).agg(F.count("*").alias("docs"), F.sum("n_findings").alias("findings"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("severity") == "high").alias("high"))


def _located(spark, d, docs) -> DataFrame:
    return FI.merged(_shown(spark, d, source=docs))


def report_json(spark, d):
    """One JSON line per document, with the text of each span."""
    docs = _corpus(spark, d)
    return FI.to_json(docs, _located(spark, d, docs)).select(KEY, F.md5(F.col("line").cast("binary")).alias("line_md5"))


def report_json_read(spark, d):
    docs = _corpus(spark, d)
    back = FI.from_json(FI.to_json(docs, _located(spark, d, docs)))
    return _long(back.select(F.col("id").cast("long").alias(KEY), "flagged", "n_findings", "severity", F.array_join("threats", ",").alias("threats"), "lo", "hi"))


def findings_evidence(spark, d):
    docs = _corpus(spark, d)
    e = FI.with_evidence(_shown(spark, d, source=docs), docs)
    said = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["rule"].cast("string"), x["edge_no"].cast("string"), x["lo"].cast("string"), x["hi"].cast("string"), x["quote"])), "|")
    return _long(e.select(KEY, "island", F.size("evidence").alias("n_evidence"), F.md5(said.cast("binary")).alias("evidence_md5")))


def findings_unlocated(spark, d):
    """Located findings, then what a detector that names no place said of every ninth document."""
    docs = _corpus(spark, d)
    unlocated = docs.where(F.col(KEY) % 9 == 0).select(KEY, F.lit("IPI/Intent").alias("threat"), F.lit("high").alias("severity"))
    return _long(FI.with_unlocated(_located(spark, d, docs), unlocated))


def finding_snippets(spark, d):
    docs = _corpus(spark, d)
    f = _located(spark, d, docs).join(docs.select(KEY, "text"), KEY)
    return _long(f.select(KEY, "island", FI.snippet(F.col("text"), F.col("lo"), F.col("hi")).alias("snippet")))


def catalog(spark, d):
    return FI.catalog(load().rules_table(spark))


def threat_explain(spark, d):
    return FI.explain(FI.catalog(load().rules_table(spark)), "override").select("threat", "severity", "exact")


def threat_names(spark, d):
    """Names for the base's rules as if none had one."""
    edges = load().edges_table(spark)
    rows = FI.techniques(edges).join(FI.signatures(edges), "rule").collect()
    made = FI.named([(r.rule, f"{r.family}.{r.technique}", r.signature) for r in rows])
    return spark.createDataFrame(sorted(made.items()), "rule long, threat string")


def threat_rank(spark, d):
    return load().rules_table(spark).select("threat", FI.rank(F.col("threat")).cast("long").alias("rank")).distinct()


def rule_signatures(spark, d):
    return _long(FI.signatures(load().edges_table(spark)))


def technique_of_rule(spark, d):
    return _long(FI.techniques(load().edges_table(spark)))


def pick_base(spark, d):
    return spark.createDataFrame([(newest(list(oracle.BASE_NAMES)),)], "name string")


def dict_expand_inflect(spark, d):
    return spark.createDataFrame([(v, x) for v in oracle.VERBS for x in inflected(v)], "phrase string, form string")


def _raw(spark, d, docs) -> DataFrame:
    return FI.merged(_shown(spark, d, -50, "ipi", docs))


def _blocked(spark, d, *columns: str) -> DataFrame:
    return G.blocked(_corpus(spark, d).select(KEY, "text", *columns), load())


def _guarded(policy: str, **how):
    def query(spark, d):
        return _long(G.edited(_blocked(spark, d), policy=policy, **how).select(KEY, "flagged", "keep", _md5(), "removed"))

    return query


def guard_metadata(spark, d):
    m = G.guarded(_corpus(spark, d).select(KEY, "text"), load(), "ipi", "mask", mask="[cut]")
    one = F.array_join(F.transform("meta.spans", lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))), ",")
    return _long(m.select(KEY, "meta.flagged", "meta.action", "meta.base", F.array_join("meta.threats", ",").alias("threats"), one.alias("spans"), "meta.removed_chars"))


def guard_drop_split(spark, d):
    """How many documents of each label are kept and rejected; both outputs are counted as they are read, once."""
    return G.edited(_blocked(spark, d, "label"), policy="drop").groupBy("label").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("rejected"))


def guard_boundary(spark, d):
    """Whole utterances around the findings, and how much of the planted sentence they hold."""
    docs = _corpus(spark, d)
    return _long(G.boundary(_raw(spark, d, docs).select(KEY, "lo", "hi"), docs).select(KEY, "lo", "hi", "block_lo", "block_hi"))


def wrapped_lines(spark, d):
    lines = _corpus(spark, d).select(KEY, F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return lines.select(KEY, (F.col("nth") + 1).cast("long").alias("nth"), G.is_wrapped(F.col("line")).alias("wrapped"))


def _turns(spark, d) -> tuple[DataFrame, DataFrame]:
    turns = X.planted_turns(_t(spark, d, "conversations"))
    keyed = turns.withColumn(KEY, F.col("conv_id") * 100000 + F.col("turn"))
    hit = _fired(spark, d, "dpi", keyed.where("role = 'user'")).select(KEY).distinct()
    return turns, keyed.join(hit, KEY, "left_semi").select("conv_id", "turn", F.lit("dpi").alias("mode"))


def dialogue_decide(spark, d):
    turns, flagged = _turns(spark, d)
    return G.decide(turns, flagged, {"user": "dpi"}, "drop").drop("threats")


def dialogue_meta(spark, d):
    turns, flagged = _turns(spark, d)
    m = G.turn_meta(turns, flagged, {"user": "dpi"}, "drop", load().version)
    return m.select("conv_id", "turn", "role", "meta.flagged", "meta.action", "meta.base")


def dialogue_stamped(spark, d):
    """What the last turn of each conversation is told of its request."""
    turns, flagged = _turns(spark, d)
    said = _fired(spark, d, "dpi", turns.where("role = 'user'").withColumn(KEY, F.col("conv_id") * 100000 + F.col("turn"))).groupBy(KEY).agg(F.array_sort(F.collect_set("threat")).alias("threats"))
    flagged = flagged.withColumn(KEY, F.col("conv_id") * 100000 + F.col("turn")).join(said, KEY).drop(KEY)
    answers = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    s = D.stamped(answers, turns, flagged, {"user": "dpi"})
    return s.select("conv_id", "turn", "guard_request_flagged", F.array_join("guard_request_threats", ",").alias("guard_request_threats"), F.size("guard_messages").cast("long").alias("n_messages"), F.size(F.map_filter("guard_messages", lambda k, v: v["flagged"])).cast("long").alias("n_flagged"))


def _tool_messages(spark, d) -> DataFrame:
    tool = F.element_at(F.array(F.lit("search"), F.lit("mail"), F.lit("clock")), (F.col(KEY) % 3 + 1).cast("int"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    return _corpus(spark, d).select(F.col(KEY).alias("message_id"), tool.alias("tool"), F.array(block("text", F.col("text")), block("image", F.lit(None).cast("string")), block("text", F.lit("plain"))).alias("blocks"))


def _tool_query(policy: str, **how):
    def query(spark, d):
        out = D.tool_outputs(_tool_messages(spark, d), load(), "ipi", policy, ("search", "mail"), **how)
        said = F.array_join(F.transform("blocks", lambda x: F.concat_ws(":", x["type"], F.coalesce(x["text"], F.lit("-")))), "|")
        return out.select("message_id", "tool", F.md5(said.cast("binary")).alias("blocks_md5"), "meta.flagged", "meta.action", F.array_join("meta.threats", ",").alias("threats"))

    return query


def tool_commands(spark, d):
    """Two messages to a command, read in their place."""
    m = _tool_messages(spark, d)
    both = m.groupBy(F.floor(F.col("message_id") / 2).alias("command_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "tool", "blocks"))), lambda x: F.struct(x["tool"].alias("tool"), x["blocks"].alias("blocks"))).alias("messages"))
    out = D.commands(both, load(), policy="drop", tools=("search", "mail"))
    return out.select("command_id", F.size("messages").cast("long").alias("n"), F.size(F.filter("messages", lambda x: x["meta"]["flagged"])).cast("long").alias("n_flagged"), F.size(F.filter("messages", lambda x: x["blocks"][0]["text"] == D.WITHHELD)).cast("long").alias("n_withheld"))


def dialogue_one_of_two(spark, d):
    turns, flagged = _turns(spark, d)
    passed, blocked = D.one_of_two(turns, G.decide(turns, flagged, {"user": "dpi"}, "drop"))
    n = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("output", F.lit(name))
    return n(passed, "messages").unionByName(n(blocked, "blocked"))


def dialogue_validated(spark, d):
    turns, flagged = _turns(spark, d)
    v = D.validated(turns, flagged, {"user": "dpi"})
    return v.select("conv_id", "turn", "role", _md5(), F.coalesce("meta.flagged", F.lit(False)).alias("flagged"))


def dialogue_parts(spark, d):
    """A message of two text parts and a tool's result: what of it is read."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.substring(F.col("text"), F.lit(1), half), F.lit(None).cast("string"), F.substring(F.col("text"), half + 1, F.length("text")))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(D.message_text(parts, F.array(F.col("role"))).cast("binary")).alias("text_md5"))


def dialogue_since_last_assistant(spark, d):
    return G.since_assistant(X.planted_turns(_t(spark, d, "conversations"))).select("conv_id", "turn", "role")


def dialogue_forget(spark, d):
    turns, flagged = _turns(spark, d)
    return G.forget(turns, flagged, oracle.REFUSAL).select("conv_id", "turn", "role", _md5())


def dialogue_text(spark, d):
    """What of a conversation is read: the texts of its turns, a blank line between."""
    said = _t(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    g = said.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return g.select("conv_id", "n", F.md5(F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").cast("binary")).alias("text_md5"))


def role_vocabulary(spark, d):
    """Our names of the roles of a host, which are written back and forth."""
    host = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return _t(spark, d, "conversations").groupBy("role", host.alias("host_role"), D.role(host).alias("back")).agg(F.count("*").alias("n"))


def _judged(spark, d) -> DataFrame:
    docs = _corpus(spark, d)
    return docs.join(_fired(spark, d, "ipi", docs).select(KEY, F.lit(True).alias("hit")).distinct(), KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall_fpr_cube(spark, d):
    return M.rate_cube(_judged(spark, d), "hit", "label", "action", "form")


def recall_ci(spark, d):
    return M.rate_interval(_judged(spark, d), "hit", "label")


def alarm_ppv(spark, d):
    return M.alarm_value(_judged(spark, d), "hit", F.col("label") == "injected", (0.001, 0.01, 0.1, 0.5))


def length_bands(spark, d):
    n = F.length("text")
    band = F.when(n < 500, "short").when(n <= 2000, "middle").otherwise("long")
    return _judged(spark, d).groupBy(band.alias("band"), "label").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def payload_survival(spark, d):
    out = G.edited(_blocked(spark, d, "label", "action", "payload"), policy="mask", mask="[cut]").where("label = 'injected'")
    return out.groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.contains(M.squeezed(F.col("text")), M.squeezed(F.col("payload")))).alias("intact"))


def survival_damage(spark, d):
    """How much of the planted sentences the mask leaves, and what it does to the documents without one."""
    n = lambda c: F.length(F.trim(M.squeezed(F.col(c))))
    injected = F.col("label") == "injected"
    out = G.edited(_blocked(spark, d, "label", "payload").withColumn("was", F.col("text")), policy="mask", mask="[cut]")
    kept = F.when(~injected, n("text") / F.greatest(F.lit(1), n("was")))
    # A document without a payload is asked for none.
    rows = out.select("label", kept.alias("kept"), F.when(injected, F.col("payload")).alias("payload"), *[F.when(injected, F.col(c)).alias(c) for c in ("was", "text")])
    s = M.survivals(rows, "payload", {"before": "was", "after": "text"}, ["label", "kept"])
    return M.damage(s.select("kept", *[F.when(injected, F.col(c)).alias(c) for c in ("before", "after")]))


def scan_mismatch(spark, d):
    """Findings of one path that the other lacks; there must be none."""
    docs = _corpus(spark, d)
    one = fused.scan(docs, load()).select(KEY, "lo", "hi", "threat", "severity", "merged")
    return M.mismatches(one, _long(_located(spark, d, docs).select(*one.columns)))


def recall_cells(spark, d):
    return M.cell_coverage(_judged(spark, d).where("label = 'injected'"), "hit", "action", "form")


def paired_gains(spark, d):
    """What apertures and refutation take from the rules whose edges occur."""
    docs = _corpus(spark, d)
    edges = _edges(spark, d, docs, "ipi", whole=True)
    all_ = S.placements(S.needed(edges, load(), "ipi"), load(), "ipi").select(KEY, F.lit(True).alias("before")).distinct()
    rows = _judged(spark, d).select(KEY, "label", F.col("hit").alias("after")).join(all_, KEY, "left").withColumn("before", F.coalesce("before", F.lit(False)))
    return M.paired(rows, "before", "after", "label")


def span_iou(spark, d):
    docs = _corpus(spark, d)
    both = _reports(spark, d).where("flagged").join(docs.where("label = 'injected'").select(KEY, "inj_lo", "inj_hi"), KEY)
    return M.overlap(both).select(KEY, "iou", "covered", "precision")


def threshold_at_budget(spark, d):
    y = F.coalesce("toxic", F.lit(0))
    score = ((F.col("doc_id") * 7919 + 13) % 1000) / F.lit(1000.0) * F.lit(0.6) + F.when(F.col("toxic") == 1, F.lit(0.35)).otherwise(F.lit(0.0))
    return M.threshold_at_budget(_t(spark, d, "labels").select(score.alias("score"), y.alias("y")), (0.001, 0.01, 0.1))


def heldout_md5(spark, d):
    return _t(spark, d, "documents").select("doc_id", M.held_out("doc_id").alias("held"))


def systematic_sample(spark, d):
    return M.systematic(_t(spark, d, "documents").select("doc_id"), "doc_id", 100)


def slice_by_goal(spark, d):
    return _corpus(spark, d).where(F.col("action").isin("exfiltrate", "disclose")).select(KEY, "action")


def size_quantiles(spark, d):
    return _long(M.quantiles(_t(spark, d, "documents").select(F.length("text").alias("size")), "size", (0.1, 0.5, 0.9, 0.99)))


def _costs(spark, d) -> DataFrame:
    n = F.length("text")
    return _t(spark, d, "documents").select("doc_id", n.cast("double").alias("size"), (F.lit(0.0018) * n + ((F.col("doc_id") * 31) % 17) * F.lit(0.01)).alias("ms"))


def cost_ols(spark, d):
    return M.cost_model(_costs(spark, d), "size", "ms")


def cost_bootstrap(spark, d):
    return M.bootstrap_slope(_costs(spark, d), "size", "ms", key="doc_id").select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def cost_summary(spark, d):
    s = F.col("size")
    band = F.when(s < 200, 0).when(s < 500, 200).when(s < 1500, 500).when(s < 4000, 1500).otherwise(4000).cast("long")
    return _costs(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.median("ms"), 6).alias("median_ms"), F.round(1000 * F.sum("size") / F.sum("ms"), 3).alias("chars_per_s"))


def dearest_per_char(spark, d):
    per = 1000 * F.col("ms") / F.col("size")
    return _costs(spark, d).where("size > 0").orderBy(per.desc(), "doc_id").limit(5).select("doc_id", F.round(per, 6).alias("per_1000"))


def shingle_neardup(spark, d):
    return M.shingle_pairs(_t(spark, d, "benchmark"), "item_id", "text")


def shingle_removed(spark, d):
    return M.without_near(_t(spark, d, "benchmark"), "item_id", "text").select("item_id")


def _fused(spark, d, how) -> DataFrame:
    return how(_corpus(spark, d), load(), "ipi").withColumn("also", F.array_join("also", ","))


def scan_fused(spark, d):
    return _fused(spark, d, fused.scan)


def scan_gated(spark, d):
    return _fused(spark, d, fused.scan_gated)


def scan_disguised(spark, d):
    """Findings in sentences behind zero-width signs, look-alikes, full-width letters and padding."""
    return fused.scan_gated(_corpus(spark, d, X.HIDDEN), load(), "ipi").withColumn("also", F.array_join("also", ","))


def intent_parse(spark, d):
    """Answers of a remote detector, read from their JSON: a document it did not judge has no flag; one flagged without spans is flagged whole."""
    score = (F.col("doc_id") % 100) / F.lit(100.0)
    answer = F.to_json(F.struct((F.col("doc_id") % 7 != 0).alias("scored"), score.alias("score"), F.struct((score >= 0.9).alias("0.001")).alias("verdicts")))
    df = _t(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.from_json(answer, "scored boolean, score double, verdicts map<string, boolean>, flagged array<struct<span: array<int>, p: double>>").alias("a"))
    flag = F.when(F.col("a.scored"), F.element_at("a.verdicts", "0.001"))
    whole = F.coalesce("a.flagged", F.array(F.struct(F.array(F.lit(0), F.col("n")).alias("span"), F.lit(None).cast("double").alias("p"))))
    at = F.when(flag, whole[0]["span"])
    return df.select("doc_id", F.col("a.scored").alias("judged"), flag.alias("flagged"), F.when(F.col("a.scored"), F.col("a.score")).alias("score"), at[0].cast("long").alias("lo"), at[1].cast("long").alias("hi"))


def alarms_per_window(spark, d):
    w = _t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


QUERIES = {
    "scan_gated": scan_gated,
    "scan_fused": scan_fused,
    "scan_disguised": scan_disguised,
    **{f.__name__: f for f in (planted_corpus, planted_dialogue, norm_hygiene, norm_homoglyph, norm_nfkc, norm_map_violations, tokens_offsets, word_offsets, paragraphs, entities_pages, entities_raw, entity_domains, entity_novelty)},
    "ent_email": _entity("EXTERNAL_ADDR"),
    "ent_url": _entity("URL_REF"),
    "ent_account": _entity("ACCOUNT_REF"),
    "ent_code_exec": _entity("CODE_EXEC"),
    "ent_path": _entity("FILE_PATH"),
    **{f.__name__: f for f in (literal_hits, hits_atomic, slot_frequency, context_counts, half_word_positions, template_fragments, edges_canonical, edges_in_region, edge_connectives, edges_pruned, edges_needed)},
    "rules_fired_ipi": _rules_fired("ipi"),
    "rules_fired_dpi": _rules_fired("dpi"),
    **{f.__name__: f for f in (rule_min_hull, rule_refutation, probe_geometry, rule_evidence, findings_evidence, findings_unlocated, finding_snippets, spans_padded, findings_merged, report_docs, report_totals, report_json, report_json_read, catalog, threat_explain, threat_names, threat_rank, rule_signatures, technique_of_rule, pick_base, dict_expand_inflect)},
    "guard_passthrough": _guarded("passthrough"),
    "guard_blank": _guarded("blank", blank="#"),
    "guard_mask": _guarded("mask", mask="[cut]"),
    "tool_outputs_mask": _tool_query("mask", mask="[cut]"),
    "tool_outputs_drop": _tool_query("drop"),
    **{f.__name__: f for f in (guard_metadata, tool_commands, dialogue_stamped, dialogue_one_of_two, dialogue_validated, dialogue_parts, survival_damage, scan_mismatch, recall_cells, paired_gains, guard_drop_split, guard_boundary, wrapped_lines, dialogue_decide, dialogue_meta, dialogue_since_last_assistant, dialogue_forget, dialogue_text, role_vocabulary, recall_fpr_cube, recall_ci, alarm_ppv, length_bands, payload_survival, span_iou, threshold_at_budget, heldout_md5, systematic_sample, slice_by_goal, size_quantiles, cost_ols, cost_bootstrap, cost_summary, dearest_per_char, shingle_neardup, shingle_removed, intent_parse, alarms_per_window)},
}
SQL = oracle.SQL
