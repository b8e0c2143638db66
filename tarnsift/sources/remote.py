"""A detector behind a service. The transport is given, so nothing here opens a connection of its own."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tries of a document, longest pause of ours and of the service's asking, in seconds.
TRIES, BACKOFF, RETRY_AFTER = 5, 30.0, 60.0
BUSY = (429, 500, 502, 503, 504)

#: From a text to (status, headers, body).
Transport = Callable[[str], tuple[int, dict[str, str], str]]


class Refused(RuntimeError):
    """The service does not answer us: key, payment, rights, or a request it can't read."""


def ask(text: str, send: Transport, sleep: Callable[[float], None] = time.sleep, tries: int = TRIES) -> str:
    """The answer's JSON for one document. One too long for the service (413) is not judged. A busy service is asked again, after what it says or twice as long each time; anything else is Refused."""
    for n in range(tries):
        status, headers, body = send(text)
        if status == 200:
            return body
        if status == 413:
            return json.dumps({"scored": False, "reason": "too long"})
        if status not in BUSY or n + 1 == tries:
            raise Refused(f"status {status}")
        said = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
        sleep(min(float(said), RETRY_AFTER) if said.replace(".", "", 1).isdigit() else min(float(2**n), BACKOFF))
    raise Refused("never asked")


def assess(docs: DataFrame, send: Transport, mode: str = "ipi", workers: int = 4, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, answer) with the service's JSON, in the order of each batch, `workers` requests of a task at a time. It knows no direct requests, so mode dpi is refused. A null text counts as empty."""
    if mode != "ipi":
        raise ValueError("the service judges ipi only")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = list(pool.map(lambda t: ask(t or "", send), b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[key, "answer"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, answer string")
