"""The rule base: JSON on disk, checked on loading, small tables in Spark."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"(rule|engine)_v(\d+)_(\d{8})_b(\d+)\.json")
MODES = ("ipi", "dpi")
SCHEMA = 3
SEVERITIES = ("high", "medium", "low")
#: Fixed values, complete and in their order: verbs whose forms replace the regular ones.
IRREGULAR = {
    "forget": ("forgets", "forgot", "forgotten", "forgetting"),
    "stop following": ("stops following", "stopped following", "stopping following"),
    "do": ("does", "did", "doing"),
    "leave out": ("leaves out", "left out", "leaving out"),
    "take no notice of": ("takes no notice of", "took no notice of"),
    "pay no attention to": ("pays no attention to", "paid no attention to"),
}
#: Verbs of our own base.
OWN_IRREGULAR = {"set aside": ("sets aside", "setting aside")}


class BaseUnavailable(ValueError):
    """No base, or one that does not hold together."""


def newest(names: list[str]) -> str | None:
    """The name of the newest readable base: by date, then schema, then build."""
    found = [(m[3], int(m[2]), int(m[4]), n) for n in names if (m := NAME.fullmatch(n)) and int(m[2]) <= SCHEMA]
    return max(found)[-1] if found else None


def inflected(phrase: str) -> set[str]:
    """Forms of the first word of a phrase, as a verb. Both spellings where doubling hangs on stress."""
    if phrase in IRREGULAR or phrase in OWN_IRREGULAR:
        return set(IRREGULAR.get(phrase, ()) or OWN_IRREGULAR[phrase])
    verb, space, tail = phrase.partition(" ")
    if len(verb) < 3 or not verb.isalpha():
        return set()
    vowel = [c in "aeiou" for c in verb]
    forms = [verb + ("es" if re.search("(s|x|z|ch|sh)$", verb) else "s")]
    if verb[-1] == "e":
        forms += [verb + "d", verb[:-1] + "ing"]
    elif verb[-1] == "y" and not vowel[-2]:
        forms += [verb[:-1] + "ied", verb + "ing"]
    else:
        forms += [verb + "ed", verb + "ing"]
        if vowel[-3:] == [False, True, False] and verb[-1] not in "wxy":
            forms += [verb + verb[-1] + "ed", verb + verb[-1] + "ing"]
    return {f + space + tail for f in forms}


@dataclass(frozen=True)
class Rule:
    index: int
    threat: str
    severity: str
    modes: tuple[str, ...]
    aperture: int | None
    aperture_frac: float | None
    edges: tuple[tuple[str, str, str, str], ...]  # anchor, filler, distance, connective


@dataclass(frozen=True)
class Base:
    version: str
    literals: tuple[tuple[str, str], ...]  # slot, literal
    entity_slots: tuple[str, ...]
    rules: tuple[Rule, ...]
    refuting: tuple[tuple[str, str, str, str, float], ...]
    thresholds: tuple[tuple[str, float], ...]

    def active(self, mode: str) -> tuple[Rule, ...]:
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {MODES}")
        return tuple(r for r in self.rules if not r.modes or mode in r.modes)

    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(f"{s}\t{x}" for s, x in self.literals)).encode()).hexdigest()

    # Small tables: their size is that of the base, whatever the corpus.
    def slots_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.literals), "slot string, literal string")

    def rules_table(self, spark: SparkSession, mode: str | None = None) -> DataFrame:
        rules = self.active(mode) if mode else self.rules
        return spark.createDataFrame([(r.index, r.threat, r.severity, list(r.modes) or None, r.aperture, r.aperture_frac, len(r.edges)) for r in rules], "rule int, threat string, severity string, modes array<string>, aperture int, aperture_frac double, n_edges int")

    def edges_table(self, spark: SparkSession, mode: str | None = None) -> DataFrame:
        rules = self.active(mode) if mode else self.rules
        return spark.createDataFrame([(r.index, k, *e) for r in rules for k, e in enumerate(r.edges)], "rule int, edge_no int, anchor string, filler string, dist string, conn string")

    def refuting_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *e) for k, e in enumerate(self.refuting)], "edge_no int, anchor string, filler string, dist string, conn string, weight double")


def parse(raw: dict, name: str | None = None) -> Base:
    if name is not None:
        m = NAME.fullmatch(name)
        if not m or (int(m[2]), m[3], int(m[4])) != (raw.get("schema"), raw.get("version"), raw.get("build")):
            raise BaseUnavailable(f"{name}: the name does not agree with the contents")
    if not isinstance(raw.get("schema"), int) or raw["schema"] > SCHEMA:
        raise BaseUnavailable(f"schema {raw.get('schema')!r} is newer than {SCHEMA}")
    literals: dict[tuple[str, str], None] = {}
    for s in raw["engine"]["slots"]:
        for v in map(str.lower, s["variants"]):
            if not v.strip():
                raise BaseUnavailable(f"empty literal in {s['slot']}")
            for x in [v, *sorted(inflected(v) if s["slot"].endswith("_VERB") else ())]:
                literals[s["slot"], x] = None
    rules = []
    for k, r in enumerate(raw["rules"]):
        if r["severity"] not in SEVERITIES or set(r.get("modes", ())) - set(MODES) or (len(r["edges"]) > 1) != (r["kind"] == "conjunction"):
            raise BaseUnavailable(f"rule {k} does not hold together")
        # An edge seen from its filler is the same edge: L is turned into R.
        edges = tuple((f, a, d, c or "") if side == "L" else (a, f, d, c or "") for a, f, side, d, c in r["edges"])
        rules.append(Rule(k, r["threat"], r["severity"], tuple(r.get("modes", ())), r.get("aperture"), r.get("aperture_frac"), edges))
    ref = raw.get("refutation", {})
    return Base(raw["version"], tuple(literals), tuple(raw.get("entity_slots", ())), tuple(rules), tuple((a, f, d, c, float(w)) for a, f, _, d, c, w in ref.get("edges", ())), tuple(ref.get("threshold", {}).items()))


@cache
def load(folder: str | None = None) -> Base:
    """The newest base of a folder, by default the one beside this file."""
    at = Path(folder) if folder else Path(__file__).parent
    name = newest([p.name for p in at.iterdir()]) if at.is_dir() else None
    if name is None:
        raise BaseUnavailable(f"no rule base in {at}")
    return parse(json.loads((at / name).read_text()), name)
