"""Documents from lines of JSON and from folders; what is skipped is counted by reason."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The largest file that is read, and in how many first bytes a NUL marks it as binary.
MAX_BYTES, PROBE = 10 << 20, 4096


def one(spark: SparkSession, text: str, name: str = "text") -> DataFrame:
    return spark.createDataFrame([(name, text)], "id string, text string")


def jsonl(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(id, text, error) per line that is not blank. id is the line's own, or file:line. error marks lines that are no JSON object; a line without the field has an empty text.

    Lines are read as lines, so a file may be split. A line's number is its place in its piece of the file plus the lines of the pieces before; the pieces are counted first.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_from"), "value", F.monotonically_increasing_id().alias("_id"))
    pieces = raw.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = raw.join(pieces.withColumn("_before", before), ["_file", "_from"]).where(F.trim("value") != "")
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    get = lambda f: F.get_json_object("value", f"$.{f}")
    sound = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    return lines.select(F.coalesce(get("id"), F.concat_ws(":", "_name", number.cast("string"))).alias("id"), F.coalesce(get(field), F.lit("")).alias("text"), (~sound).alias("error"))


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, text, reason) of files that are named one by one: none is passed over for its size, name or content; what can't be read has reason `unreadable`."""
    return _read(spark, [(p, None) for p in paths], None)


def walk(spark: SparkSession, root: str, recursive: bool = False, hidden: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, text, reason) of everything in a folder that driver and executors share. What is not read has no text and one reason: `folder` (one below it, not entered), `hidden` (a part of the name begins with a dot), `too large`, `unreadable`, `binary`. Names and sizes come to the driver, contents do not."""
    top, listed = Path(root), []
    for p in sorted(top.rglob("*") if recursive else top.iterdir()):
        try:
            if p.is_dir():
                if not recursive:
                    listed.append((str(p), "folder"))
            elif p.is_file():
                away = not hidden and any(x.startswith(".") for x in p.relative_to(top).parts)
                listed.append((str(p), "hidden" if away else "too large" if p.stat().st_size > max_bytes else None))
        except OSError:
            listed.append((str(p), "unreadable"))
    return _read(spark, listed, PROBE)


def _read(spark: SparkSession, listed: list[tuple[str, str | None]], probe: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, reasons = [], []
            for at, reason in zip(b.column("id").to_pylist(), b.column("reason").to_pylist(), strict=True):
                text = None
                if reason is None:
                    try:
                        data = Path(at).read_bytes()
                        reason = "binary" if probe and b"\0" in data[:probe] else None
                        text = None if reason else data.decode("utf-8", "replace")
                    except OSError:
                        reason = "unreadable"
                texts.append(text)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(reasons, pa.string())], names=["id", "text", "reason"])

    n = max(1, min(len(listed), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(listed, "id string, reason string").repartition(n, "id").mapInArrow(run, "id string, text string, reason string")


def folder(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, text, reason) per file; reason is null, `too large` or `binary` (a NUL among the first bytes), and such a file has no text. Bytes that are no UTF-8 are replaced. Names that begin with a dot or an underscore are hidden and not listed. Contents of files that are too large are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    small = files.where(F.col("length") <= max_bytes)
    binary = F.instr(F.substring(F.col("content"), 1, PROBE).cast("string"), "\0") > 0
    read = small.select(F.col("path").alias("id"), F.when(~binary, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.when(binary, F.lit("binary")).alias("reason"))
    large = files.where(F.col("length") > max_bytes).select(F.col("path").alias("id"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("reason"))
    return read.unionByName(large)


def skipped(files: DataFrame) -> DataFrame:
    """(reason, n) of what was not read."""
    return files.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
