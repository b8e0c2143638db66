"""The command line: scans texts, files, folders, lines of JSON or what is piped in, and ends with 0 (nothing fired), 1 (something did), 2 (wrong use) or 3 (no base).

    python -m tarnsift.cli [PATH ...] [--text TEXT] [--jsonl] [--field text] [-r] [--all] [--max-mb 10] [--mode ipi] [--json] [--report FOLDER] [--collect FOLDER] [--exit-zero]
"""

from __future__ import annotations

import argparse
import os
import re
import stat
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import MODES, Base, BaseUnavailable, load
from .operators import findings as FI
from .plans import fused
from .sources import files, sinks

QUIET, FOUND, USAGE, NO_BASE = 0, 1, 2, 3
#: Words that no result may be described with, as a scan finds but part of what there is.
FORBIDDEN = ("safe", "clean", "secure", "protected", "harmless", "benign", "trusted")


def forbidden(output: str) -> list[str]:
    """Whole words of the output that claim too much."""
    return sorted({w.lower() for w in re.findall(r"\w+", output)} & set(FORBIDDEN))


def piped() -> bool:
    """Whether standard input is a pipe or a file; a terminal or device is not."""
    try:
        kind = os.fstat(sys.stdin.fileno()).st_mode
    except (AttributeError, OSError, ValueError):
        return False
    return stat.S_ISFIFO(kind) or stat.S_ISREG(kind)


def documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(id, text, reason) of all that is asked for: the text, what is piped in, the paths, or else the working folder without those below it."""
    if a.text is not None:
        return files.one(spark, a.text).withColumn("reason", F.lit(None).cast("string"))
    if not a.paths and piped():
        return files.one(spark, sys.stdin.buffer.read().decode("utf-8", "replace"), "stdin").withColumn("reason", F.lit(None).cast("string"))
    paths = a.paths or ["."]
    if missing := [p for p in paths if not os.path.exists(p)]:
        raise FileNotFoundError(", ".join(missing))
    if a.jsonl:
        return files.jsonl(spark, paths, a.field).select("id", "text", F.when(F.col("error"), F.lit("no JSON")).alias("reason"))
    folders = [p for p in paths if os.path.isdir(p)]
    parts = [files.walk(spark, p, a.recursive and bool(a.paths), a.all, int(a.max_mb * (1 << 20))) for p in folders]
    if named := [p for p in paths if p not in folders]:
        parts.append(files.files(spark, named))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reported(docs: DataFrame, base: Base, mode: str) -> tuple[DataFrame, DataFrame]:
    """(documents with a number of their own, findings by that number)."""
    keyed = docs.where("reason is null").withColumn("doc_key", F.monotonically_increasing_id())
    found = fused.scan(keyed, base, mode)
    island = F.row_number().over(FI.Window.partitionBy("doc_key").orderBy("lo", "hi"))
    return keyed, found.withColumn("island", island)


def scan(spark: SparkSession, a: argparse.Namespace, say=print) -> int:
    base = load(a.base)
    docs = documents(spark, a).persist()
    keyed, found = reported(docs, base, a.mode)
    keyed, found = keyed.persist(), found.persist()
    n, flagged, findings = keyed.count(), found.select("doc_key").distinct().count(), found.count()
    skipped = {r.reason: r.n for r in files.skipped(docs).orderBy("reason").collect()}
    lines = FI.to_json(keyed, found).join(keyed.select("doc_key", F.col("id").alias("name")), "doc_key")
    if a.json:
        say(sinks.header("tarnsift", base.version))
        for r in lines.orderBy("doc_key").toLocalIterator():
            say(r.line)
    else:
        shown = found.join(keyed, "doc_key").select("doc_key", "id", "island", "threat", "severity", FI.snippet(F.col("text"), F.col("lo"), F.col("hi")).alias("at"))
        for r in shown.orderBy("doc_key", "island").toLocalIterator():
            say(f"{r.id}: {r.threat} ({r.severity})\n    {r.at}")
        say(f"{n} documents read, {findings} findings in {flagged} of them" + "".join(f"; {k}: {v}" for k, v in skipped.items()) + f". Base {base.version}, mode {a.mode}; what did not fire may still be there.")
    hit = keyed.join(found.select("doc_key").distinct(), "doc_key", "left_semi")
    if a.report:
        lines.join(hit.select("doc_key"), "doc_key", "left_semi").select(F.col("line").alias("value")).write.mode("overwrite").text(a.report)
    if a.collect:
        sinks.copied(hit, a.collect).count()
    return FOUND if flagged and not a.exit_zero else QUIET


def main(argv: list[str] | None = None, spark: SparkSession | None = None, say=print) -> int:
    p = argparse.ArgumentParser(prog="tarnsift", description=__doc__.split("\n")[0])
    p.add_argument("paths", nargs="*")
    p.add_argument("--text")
    p.add_argument("--jsonl", action="store_true")
    p.add_argument("--field", default="text")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--all", action="store_true", help="hidden files too")
    p.add_argument("--max-mb", type=float, default=files.MAX_BYTES / (1 << 20))
    p.add_argument("--mode", choices=MODES, default="ipi")
    p.add_argument("--base")
    p.add_argument("--json", action="store_true")
    p.add_argument("--report")
    p.add_argument("--collect")
    p.add_argument("--exit-zero", action="store_true")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return QUIET if e.code == 0 else USAGE
    if a.collect and Path(a.collect).is_file():
        return USAGE
    session = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        return scan(session, a, say)
    except BaseUnavailable as e:
        print(e, file=sys.stderr)
        return NO_BASE
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return USAGE
    finally:
        session.catalog.clearCache()


if __name__ == "__main__":
    sys.exit(main())
