"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its own sample texts. A text is compressed with every dictionary; the language of the smallest result wins, and a narrow margin marks the answer as rejected.

Edge cases: a null text, an empty one and one without a letter give `und` with score 0. Equal sizes go to the language with more training rows, then the lesser name. Without any labelled row every text is `und`. Very long texts are compressed whole, block by block. Repeated rows are answered alike; an empty table gives no rows, and trains no language; other columns are never read. More than MOST_LANGUAGES different labels are refused: that is no column of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoded, fold, held_out, local, mapped, process_cache, table

UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[a-z]")
SPACED = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))

#: Training takes at most so many labelled rows and so many bytes of folded text per language.
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 96 * 1024
#: Bytes of all dictionaries together, which the workers get, and different labels at most.
ALL_BYTES, MOST_LANGUAGES = 32 << 20, 10_000
#: A lead under this share of the best size is called narrow.
NARROW = 0.01
#: Texts are compressed in blocks of so many bytes, all of them, so that the dictionary and not the text's own past decides.
BLOCK = 2048
FILL = b" " * 128


def folded(text: str) -> bytes:
    """UTF-8 of the lower-cased text, runs of other ASCII than letters as one space; empty if there is no letter."""
    b = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split())
    return b if ASCII_LETTER.search(b) or any(c.isalpha() for c in text) else b""


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of rows, from at most `rows` labelled rows of each language in the order of a hash of the key, as far as they fit. Texts of over a quarter of a dictionary are left out. Rows are chosen and cut in the executors; only dictionaries come to the driver, ALL_BYTES at most."""
    named = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.lit("language sample")).alias("h"))
    counts = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels")
    if not counts:
        return []
    size = min(size, ALL_BYTES // len(counts))
    # The share of hashes that holds `rows` rows with a little over.
    span = {k: min(1.0, (rows + 4 * rows**0.5) / n) for k, n in counts.items()}
    u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    shares = local(docs.sparkSession, sorted(span.items()), pa.schema([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [folded(t.decode("utf-8", "replace")) for t in encoded(b)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(some, pa.binary())], names=["lang", "h", "text"])

    picked = named.join(F.broadcast(shares), "lang").where(u < F.col("share")).select("lang", "h", "text").transform(mapped, run, "lang string, h long, text binary")
    picked = picked.where((F.length("text") > 0) & (F.length("text") < size // 4))
    order = Window.partitionBy("lang").orderBy("h", "text")
    room = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = picked.withColumn("room", room).withColumn("nth", F.row_number().over(order)).where((F.col("room") <= size) & (F.col("nth") <= rows))
    parts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in fits.select("lang", "nth", "text").toArrow().sort_by([("lang", "ascending"), ("nth", "descending")]).to_pylist():
        parts[r["lang"]].append(r["text"])
    return [(k, b" ".join(parts[k])) for k in sorted(counts, key=lambda k: (-counts[k], k))]


def _compressors(model: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    cache = process_cache()
    key = ("language", hash(tuple(model)))
    if key not in cache:
        made = []
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=2, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        for _, content in model:
            d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        cache[key] = made
    return cache[key]


def classify(texts: list[str | None], model: list[tuple[str, bytes]], narrow: float = NARROW) -> list[tuple[str, float, float, bool]]:
    """(language, score, margin, rejected) of each text. The score is the share of the winner when each language weighs 2 to the minus its bits per 32 bytes of text."""
    made = _compressors(model)
    names = [n for n, _ in model]
    out = []
    for t in texts:
        b = folded(t) if t else b""
        if not b or not made:
            out.append((UNKNOWN, 0.0, 0.0, True))
            continue
        blocks = [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
        # zstandard keeps a short block raw when it gains too little; with the same run of spaces everywhere, it always codes.
        blocks[-1] += FILL
        sizes = np.array([sum(len(c.compress(x)) for x in blocks) for c in made], float)
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else 1.0
        bits = 8 * (sizes - sizes[best]) / max(1.0, len(b) / 32)
        out.append((names[best], float(1 / np.exp2(-bits).sum()), margin, margin < narrow))
    return out


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text", key: str = "doc_id", narrow: float = NARROW) -> DataFrame:
    """Per row: the key, lang_pred, score, margin, rejected."""
    kind = docs.schema[key].dataType.simpleString()
    df = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = classify([t.decode("utf-8", "replace") for t in encoded(b)], model, narrow)
            lang, score, margin, rejected = zip(*got, strict=True) if got else ((), (), (), ())
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip((lang, score, margin, rejected), schema.types[1:], strict=True))], schema=schema)

    return df.transform(mapped, run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id")) != 0))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


