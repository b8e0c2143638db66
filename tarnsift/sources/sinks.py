"""Reports as lines of JSON, and copies of flagged documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = 1


def header(engine: str, version: str) -> str:
    return json.dumps({"schema": SCHEMA, "engine": engine, "engine_version": version})


def ndjson(reports: DataFrame, path: str, engine: str, version: str, flagged_only: bool = False) -> None:
    """One line per document under path/documents, the header under path/header."""
    rows = reports.where("flagged") if flagged_only else reports
    reports.sparkSession.createDataFrame([(header(engine, version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/documents")


def safe_name(path: Column) -> Column:
    """A relative name that cannot leave its folder: scheme, drive, leading slashes and parent steps go."""
    p = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://)?", ""), r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_. -]", "_")), "/")


def named(rows: DataFrame, id: str = "id") -> DataFrame:
    """The rows with copy, a name of their own: what comes again under a name gets _1, _2 and so on, past all numbers that names of its kind have, so that no made name meets a real one."""
    form = r"^(.*?)(?:_([0-9]{1,9}))*(\.[^./]*)?$"
    part = lambda i: F.regexp_extract("_safe", form, i)
    df = rows.withColumn("_safe", safe_name(F.col(id))).withColumn("_stem", part(1)).withColumn("_end", part(3))
    df = df.withColumn("_nth", F.row_number().over(Window.partitionBy("_safe").orderBy(id)))
    family = Window.partitionBy("_stem", "_end")
    most = F.coalesce(F.max(F.when(part(2) != "", part(2).cast("long"))).over(family), F.lit(0))
    again = F.sum(F.when(F.col("_nth") > 1, 1).otherwise(0)).over(family.orderBy("_safe", "_nth"))
    made = F.concat("_stem", F.lit("_"), (most + again).cast("string"), "_end")
    return df.withColumn("copy", F.when(F.col("_nth") == 1, F.col("_safe")).otherwise(made)).drop("_safe", "_stem", "_end", "_nth")


def copied(rows: DataFrame, folder: str, text: str = "text", id: str = "id") -> DataFrame:
    """Writes each text under folder, a folder that all executors share, as its copy name; (id, copy) of what was written. What is there already is not overwritten but refused. Run again after a loss, a task finds its own files equal and goes on."""
    import os
    from pathlib import Path

    def run(batches):
        for b in batches:
            for name, t in zip(b.column("copy").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = Path(folder, name)
                at.parent.mkdir(parents=True, exist_ok=True)
                data = (t or "").encode()
                if at.exists() and at.read_bytes() != data:
                    raise FileExistsError(str(at))
                part = at.with_name(f".{at.name}.{os.getpid()}")
                part.write_bytes(data)
                part.replace(at)
            yield b.select(["id", "copy"])

    return named(rows, id).select(F.col(id).cast("string").alias("id"), "copy", F.col(text).alias("text")).mapInArrow(run, "id string, copy string")
