"""Findings, merged where they touch, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base.techniques import DESCRIPTIONS, FALLBACK, ORDER, TECHNIQUES

def severity_order(c: Column) -> Column:
    return F.coalesce(*[F.when(c == s, F.lit(i)) for i, s in enumerate(ORDER)], F.lit(len(ORDER)))


def rank(threat: Column) -> Column:
    """Place of the threat's technique in the table; what is not in it comes last."""
    name = F.regexp_extract(threat, r"^IPI/([A-Za-z]+\.[A-Za-z]+)", 1)
    return F.coalesce(*[F.when(name == f"{f}.{t}", F.lit(i)) for i, (f, t, *_) in enumerate(TECHNIQUES)], F.lit(len(TECHNIQUES)))


def islands(spans: DataFrame, key: str, lo: str = "span_lo", hi: str = "span_hi", *order: str) -> DataFrame:
    """The rows with island, a number per key: touching spans share one."""
    w = Window.partitionBy(key).orderBy(lo, hi, *order)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0)
    return spans.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(w).cast("int")).drop("_opens")


def merged(found: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, island, lo, hi, threat, severity, also, refs, merged) from rows with span_lo, span_hi, threat, severity, rule. The headline is the gravest, then most specific, then narrowest, then least by name."""
    ranked = islands(found, key, "span_lo", "span_hi", "rule").withColumn("head", F.struct(severity_order(F.col("severity")).alias("s"), rank(F.col("threat")).alias("r"), (F.col("span_hi") - F.col("span_lo")).alias("w"), F.col("threat").alias("threat"), F.col("severity").alias("severity")))
    g = ranked.groupBy(key, "island").agg(F.min("span_lo").alias("lo"), F.max("span_hi").alias("hi"), F.min("head").alias("head"), F.collect_set("threat").alias("names"), F.array_sort(F.collect_set("rule")).alias("refs"), F.count("*").alias("merged"))
    also = F.array_sort(F.array_except("names", F.array("head.threat")))
    return g.select(key, "island", "lo", "hi", "head.threat", "head.severity", also.alias("also"), "refs", "merged")


def reports(docs: DataFrame, findings: DataFrame, key: str = "doc_key") -> DataFrame:
    """One row per document, also without findings: flagged, n_findings, severity, threats (by first appearance), lo, hi."""
    first = F.array_sort(F.collect_list(F.struct("island", "threat")))
    g = findings.groupBy(key).agg(F.count("*").alias("n"), F.min(severity_order(F.col("severity"))).alias("s"), first.alias("seen"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    df = docs.select(key).join(g, key, "left")
    worst = F.coalesce(*[F.when(F.col("s") == i, F.lit(x)) for i, x in enumerate(ORDER)])
    threats = F.coalesce(F.array_distinct(F.transform("seen", lambda x: x["threat"])), F.array().cast("array<string>"))
    return df.select(key, F.col("n").isNotNull().alias("flagged"), F.coalesce("n", F.lit(0)).alias("n_findings"), worst.alias("severity"), threats.alias("threats"), "lo", "hi")


def with_evidence(found: DataFrame, docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """merged() with evidence: (rule, edge_no, lo, hi, quote) of every edge of the rules in it, each once, in the order of spans. found: rows of shown() with edge_spans."""
    marked = islands(found, key, "span_lo", "span_hi", "rule")
    each = marked.select(key, "island", "span_lo", "span_hi", "rule", F.posexplode("edge_spans").alias("edge_no", "at")).join(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")), key)
    quote = F.substring(F.col("_t"), F.col("at.lo") + 1, F.col("at.hi") - F.col("at.lo"))
    item = F.struct("span_lo", "span_hi", "rule", "edge_no", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), quote.alias("quote"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["rule"].alias("rule"), x["edge_no"].alias("edge_no"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["quote"].alias("quote")))
    return merged(found, key).join(each.groupBy(key, "island").agg(F.array_distinct(ordered).alias("evidence")), [key, "island"])


def with_unlocated(findings: DataFrame, unlocated: DataFrame, key: str = "doc_key") -> DataFrame:
    """Located findings, then those without a span (key, threat, severity), which never merge, numbered on behind them."""
    none = [F.lit(None).cast("int").alias(c) for c in ("island", "lo", "hi")]
    both = findings.select(key, "island", "lo", "hi", "threat", "severity", F.lit(False).alias("_rest")).unionByName(unlocated.select(key, *none, "threat", "severity", F.lit(True).alias("_rest")))
    # The findings are read once: numbers follow on the last of the same key.
    last = F.max("island").over(Window.partitionBy(key))
    nth = F.row_number().over(Window.partitionBy(key, "_rest").orderBy("threat", "severity"))
    island = F.when(F.col("_rest"), F.coalesce(last, F.lit(0)) + nth).otherwise(F.col("island"))
    return both.select(key, island.alias("island"), "lo", "hi", "threat", "severity")


REPORT = "lo bigint, hi bigint, threat string, severity string"


def to_json(docs: DataFrame, findings: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, line): the report of each document with its findings and the text of each span, as one line of JSON."""
    t = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    item = F.struct("lo", "hi", "threat", "severity", F.when(F.col("lo").isNotNull(), F.substring(F.col("_t"), F.col("lo") + 1, F.col("hi") - F.col("lo"))).alias("text"))
    g = findings.join(t, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("island", item.alias("f")))).alias("_f"))
    list_ = F.coalesce(F.transform("_f", lambda x: x["f"]), F.array().cast(f"array<struct<{REPORT.replace(' bigint', ':int').replace(' string', ':string').replace(', ', ',')},text:string>>"))
    df = reports(docs, findings, key).join(g, key, "left")
    return df.select(key, F.to_json(F.struct(F.col(key).alias("id"), "flagged", "severity", "threats", list_.alias("findings"))).alias("line"))


def from_json(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id, flagged, n_findings, severity, threats, lo, hi) read back from lines of to_json(); what follows from the findings is made anew, whatever the line says."""
    r = F.from_json(F.col(line), f"id string, findings array<struct<{REPORT.replace(' ', ':').replace(',:', ',')}>>")
    f = F.col("r.findings")
    worst = F.array_min(F.transform(f, lambda x: severity_order(x["severity"])))
    named = F.coalesce(*[F.when(worst == i, F.lit(x)) for i, x in enumerate(ORDER)])
    return lines.select(r.alias("r")).select(F.col("r.id").alias("id"), (F.size(f) > 0).alias("flagged"), F.size(f).cast("long").alias("n_findings"), named.alias("severity"), F.array_distinct(F.transform(f, lambda x: x["threat"])).alias("threats"), F.array_min(F.transform(f, lambda x: x["lo"])).alias("lo"), F.array_max(F.transform(f, lambda x: x["hi"])).alias("hi"))


#: Characters shown beside a span, and of a span before its middle is left out.
CONTEXT, BUDGET = 90, 600


def snippet(text: Column, lo: Column, hi: Column) -> Column:
    """The span between >>> and <<<, with whole words around it; of a long span the ends."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    body, start = one(F.substring(text, lo + 1, hi - lo)), F.greatest(F.lit(0), lo - CONTEXT)
    n = F.length(body)
    body = F.when(n > BUDGET, F.concat(F.substring(body, F.lit(1), F.lit(BUDGET // 2)), F.lit(" […"), (n - BUDGET).cast("string"), F.lit(" chars…] "), F.substring(body, n - BUDGET // 2 + 1, F.lit(BUDGET // 2)))).otherwise(body)
    before, after = one(F.substring(text, start + 1, lo - start)), one(F.substring(text, hi + 1, F.lit(CONTEXT)))
    before = F.when((lo > CONTEXT) & (before != ""), F.concat(F.lit("… "), F.regexp_replace(before, "^[^ ]* ?", ""))).otherwise(before)
    after = F.when((hi + CONTEXT < F.length(text)) & (after != ""), F.concat(F.regexp_replace(after, "(?:^| )[^ ]*$", ""), F.lit(" …"))).otherwise(after)
    return F.concat(F.when(before != "", F.concat(before, F.lit(" "))).otherwise(""), F.lit(">>>"), body, F.lit("<<<"), F.when(after != "", F.concat(F.lit(" "), after)).otherwise(""))


def techniques(edges: DataFrame) -> DataFrame:
    """(rule, family, technique, severity) of rules by the slots of their edges (rule, anchor, filler)."""
    spark = edges.sparkSession
    table = spark.createDataFrame([(i, f, t, s, slot) for i, (f, t, s, slots) in enumerate(TECHNIQUES) for slot in slots], "ord int, family string, technique string, severity string, slot string")
    slots = edges.select("rule", F.explode(F.array("anchor", "filler")).alias("slot")).distinct()
    best = slots.join(F.broadcast(table), "slot", "left").groupBy("rule").agg(F.min(F.when(F.col("ord").isNotNull(), F.struct("ord", "family", "technique", "severity"))).alias("best"))
    return best.select("rule", *[F.coalesce(f"best.{n}", F.lit(x)).alias(n) for n, x in zip(("family", "technique", "severity"), FALLBACK, strict=True)])


def signatures(edges: DataFrame) -> DataFrame:
    """(rule, signature) from the base's edges."""
    one = F.concat_ws("|", "anchor", "filler", F.lit("R"), "dist", "conn")
    return edges.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list(one)), "&").alias("signature"))


def catalog(rules: DataFrame) -> DataFrame:
    """(threat, severity, family, technique, description, n_rules, rules), by threat; rules as numbers, comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("rule")), lambda x: x.cast("string")), ",")
    g = rules.groupBy("threat").agg(F.min_by("severity", severity_order(F.col("severity"))).alias("severity"), F.count("*").alias("n_rules"), ids.alias("rules"))
    part = lambda i: F.regexp_extract("threat", r"^[A-Z]+/([A-Za-z]+)\.([A-Za-z]+)", i)
    said = F.coalesce(*[F.when(F.concat_ws(".", part(1), part(2)) == k, F.lit(v)) for k, v in DESCRIPTIONS.items()], F.lit(""))
    return g.select("threat", "severity", part(1).alias("family"), part(2).alias("technique"), said.alias("description"), "n_rules", "rules")


def explain(known: DataFrame, name: str, most: int = 10) -> DataFrame:
    """The catalogue's row of a threat, or else, with exact false, up to `most` whose names hold the word asked for, whatever its case."""
    exact = known.where(F.col("threat") == name).withColumn("exact", F.lit(True))
    near = known.where((F.col("threat") != name) & F.contains(F.lower("threat"), F.lit(name.lower()))).withColumn("exact", F.lit(False)).orderBy("threat").limit(most)
    return exact.unionByName(near.join(exact.select(F.lit(1)).limit(1), how="left_anti")) if name else near


def letters(n: int) -> str:
    """A to Z, then Z1, Z2, ..."""
    return chr(65 + n) if n < 26 else f"Z{n - 25}"


def named(rules: list[tuple[int, str, str]], before: dict[str, str] | None = None, group: str = "IPI") -> dict[int, str]:
    """Threat names of rules (number, Family.Technique, signature): one known by its signature keeps its name, others take the next letter of their technique that no name, old or new, has."""
    before = before or {}
    used: dict[str, set[str]] = {}
    for name in before.values():
        stem, _, letter = name.rpartition(".")
        used.setdefault(stem, set()).add(letter)
    out = {}
    for number, technique, signature in sorted(rules):
        stem = f"{group}/{technique}"
        if (kept := before.get(signature, "")).rpartition(".")[0] == stem:
            out[number] = kept
            continue
        taken = used.setdefault(stem, set())
        letter = next(x for x in map(letters, range(len(taken) + 1)) if x not in taken)
        taken.add(letter)
        out[number] = f"{stem}.{letter}"
    return out


def annotated(raw: dict, names: dict[int, str]) -> dict:
    """A base with the threats of its rules named; nothing else may differ."""
    import copy

    out = copy.deepcopy(raw)
    for k, rule in enumerate(out["rules"]):
        rule["threat"] = names[k]
    stripped = [{**r, "threat": None} for r in raw["rules"]], [{**r, "threat": None} for r in out["rules"]]
    assert stripped[0] == stripped[1] and {k: v for k, v in raw.items() if k != "rules"} == {k: v for k, v in out.items() if k != "rules"}
    return out
