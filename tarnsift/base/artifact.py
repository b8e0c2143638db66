"""A base in one file: its literals, rules and fingerprint, made ahead, checked against its sources on loading. JSON under gzip; nothing in it is run."""

from __future__ import annotations

import gzip
import json
from dataclasses import asdict
from pathlib import Path

from . import Base, BaseUnavailable, Rule

FORMAT = 1


def compiled(base: Base) -> dict:
    return {"format": FORMAT, "fingerprint": base.fingerprint(), "phrases": len(base.literals), "slots": len({s for s, _ in base.literals}), "base": asdict(base)}


def write(base: Base, at: str) -> None:
    Path(at).write_bytes(gzip.compress(json.dumps(compiled(base), ensure_ascii=False, sort_keys=True).encode(), mtime=0))


def _read(at: str) -> dict:
    try:
        raw = json.loads(gzip.decompress(Path(at).read_bytes()))
    except (OSError, ValueError, EOFError) as e:
        raise BaseUnavailable(f"{at} can't be read: {e}") from e
    if raw.get("format") != FORMAT:
        raise BaseUnavailable(f"{at} has format {raw.get('format')!r}, not {FORMAT}")
    return raw


def load(at: str) -> Base:
    raw = _read(at)
    b = raw["base"]
    pairs = lambda rows: tuple(map(tuple, rows))
    rules = tuple(Rule(**{**r, "modes": tuple(r["modes"]), "edges": pairs(r["edges"])}) for r in b["rules"])
    base = Base(b["version"], pairs(b["literals"]), tuple(b["entity_slots"]), rules, pairs(b["refuting"]), pairs(b["thresholds"]))
    if base.fingerprint() != raw["fingerprint"]:
        raise BaseUnavailable(f"{at}: the fingerprint does not agree with the literals")
    return base


def verify(at: str, source: Base) -> list[str]:
    """What in the file differs from its source; nothing if it is up to date."""
    raw, want, out = _read(at), compiled(source), []
    for k in ("fingerprint", "phrases", "slots"):
        if raw[k] != want[k]:
            out.append(f"{k}: {raw[k]!r} in the file, {want[k]!r} in the source")
    have, wanted = ({tuple(x) for x in r["base"]["literals"]} for r in (raw, want))
    out += [f"literal {s}: {x!r} is only in the file" for s, x in sorted(have - wanted)] + [f"literal {s}: {x!r} is missing" for s, x in sorted(wanted - have)]
    for k in ("version", "rules", "refuting", "thresholds", "entity_slots"):
        if json.loads(json.dumps(raw["base"][k])) != json.loads(json.dumps(want["base"][k])):
            out.append(f"{k} differ")
    return out


def describe(base: Base, mode: str) -> dict:
    """What the base holds for one mode, and nothing of the others."""
    rules = base.active(mode)
    return {"version": base.version, "mode": mode, "rules": len(rules), "threats": sorted({r.threat for r in rules}), "slots": sorted({s for r in rules for a, f, *_ in r.edges for s in (a, f)}), "refutes": mode in dict(base.thresholds), "fingerprint": base.fingerprint()}
