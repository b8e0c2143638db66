"""Secrets: fixed patterns, and strings that look random to character Markov models.

Two models of the same order (two characters), one of random strings and one of ordinary identifiers, are trained from labelled samples with interpolated smoothing. Every run of at least SHORTEST signs of keys is scored, whatever it is made of: it is a secret if its whole log-likelihood ratio reaches the threshold, so a short string must look more random in each sign than a long one.

Edge cases: a null text counts as empty. Very long texts are scored whole, in memory of some times their size. Ties (a ratio equal to the threshold) count as secrets. Failing matches of the fixed patterns are dropped whole, without retries. Learned spans never overlap base spans. Repeated rows are answered alike; an empty table gives no rows; no other column is read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mapped, process_cache, slices, table

KINDS = ("assign", "access", "hex")
LEARNED = "random"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1
#: Code of each byte; the last is any other sign, and the start.
_CODE = np.full(256, N - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(N - 1)
#: The least log-likelihood ratio of a secret (nats), least length, and weight of the shorter context in smoothing.
THRESHOLD, SHORTEST, SMOOTH = 25.0, 8, 4.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def vocabulary(path: str | None = None) -> list[str]:
    """Ordinary words and parts of words: the tokens of letters in a file of base64 tokens, by default the installed one of many languages."""
    import base64

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip() for line in f]
    return sorted({t for t in tokens if len(t) >= 3 and t.isascii() and t.isalpha()})


def samples(seed: int = 7, n: int = 20_000, path: str | None = None) -> list[tuple[str, int]]:
    """Labelled strings: 1 random keys in the usual alphabets, 0 identifiers, paths, words, numbers and dates put together from ordinary parts."""
    r, words = random.Random(seed), vocabulary(path)
    digits, upper, lower = ALPHABET[52:62], ALPHABET[:26], ALPHABET[26:52]
    kinds = (upper + lower + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + lower, upper + digits, lower + digits, upper, lower, "0123456789abcdef")
    out = [("".join(r.choices(r.choice(kinds), k=r.randint(12, 64))), 1) for _ in range(n)]
    for _ in range(n):
        some = [r.choice(words) for _ in range(r.randint(1, 5))]
        low = [w.lower() for w in some]
        made = r.randrange(9)
        s = ["_".join(low), "-".join(low), "/".join(low), "".join(w.capitalize() for w in low), low[0] + "".join(w.capitalize() for w in low[1:]), "".join(low), "_".join(low).upper(), "".join(low).upper(), "".join(some)][made]
        if r.random() < 0.4:
            s += r.choice(["", "-", "_", "/"]) + str(r.choice([r.randint(1, 99), r.randint(1990, 2035), f"{r.randint(1990, 2035)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", r.randint(100, 99999)]))
        out.append((s, 0))
    for _ in range(n // 4):
        out.append((r.choice(["-", "=", "_", "/", "+", r.choice(ALPHABET)]) * r.randint(8, 60), 0))
        out.append(("".join(r.choices(digits, k=r.randint(1, 24))), 0))
        out.append((r.choice(["-", "/"]).join("".join(r.choices(digits, k=r.randint(1, 5))) for _ in range(r.randint(2, 5))), 0))
    return out


def _grams(texts: list[bytes]) -> np.ndarray:
    """Codes of each character of the strings after the two before it, as one number."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return _indexed(joined)[joined != 32]


def _indexed(joined: np.ndarray) -> np.ndarray:
    c = _CODE[joined]
    one = np.concatenate([[N - 1], c[:-1]])
    two = np.where(one == N - 1, N - 1, np.concatenate([[N - 1, N - 1], c[:-2]])[: len(c)])
    return (two * N + one) * N + c


def _table(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each character after two, from counts (2, N, N, N) by label."""
    logs = []
    for three in counts.astype(float):
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p = (one + 0.5) / (one.sum() + 0.5 * N)
        p = (two + SMOOTH * p) / (two.sum(axis=1, keepdims=True) + SMOOTH)
        p = (three + SMOOTH * p) / (three.sum(axis=2, keepdims=True) + SMOOTH)
        logs.append(np.log(p))
    return (logs[1] - logs[0]).ravel()


def train(labelled: DataFrame | Iterable[tuple[str, int]], text: str = "text", label: str = "label") -> np.ndarray:
    """The table of ratios, from a table of labelled strings (1 random, 0 ordinary) of any size or from pairs. Of a table only counts come to the driver, as many at most as the models have cells; null strings or labels are left out."""
    counts = np.zeros((2, N**3))
    if isinstance(labelled, DataFrame):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = b.column("label").to_numpy()
                for k in (0, 1):
                    at, n = np.unique(_grams([t for t, x in zip(encoded(b), y, strict=True) if x == k]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n)], names=["label", "gram", "n"])

        rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("long").alias("label")).where("text is not null and label in (0, 1)")
        got = rows.transform(mapped, run, "label long, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("label").to_numpy(), got.column("gram").to_numpy()] = got.column("n").to_numpy()
    else:
        pairs = [(s.encode(), int(y)) for s, y in labelled]
        for k in (0, 1):
            np.add.at(counts[k], _grams([s for s, y in pairs if y == k]), 1)
    return _table(counts.reshape(2, N, N, N))


def ratio(s: str, model: np.ndarray) -> float:
    """The log-likelihood ratio of a whole string."""
    return float(model[_grams([s.encode()])].sum()) if s else 0.0


def candidates(texts: list[bytes], model: np.ndarray, threshold: float) -> list[list[tuple[int, int]]]:
    """Byte spans of the runs of each text that reach the threshold."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    c = _CODE[joined] < N - 1
    change = np.flatnonzero(c[1:] != c[:-1]) + 1
    if len(c) and c[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    sums = np.concatenate([[0.0], np.cumsum(model[_indexed(joined)])])
    # Sums over a whole batch lose some digits; what is near the threshold is summed again by itself.
    total = sums[ends] - sums[starts]
    for i in np.flatnonzero(np.abs(total - threshold) < 1e-3).tolist():
        total[i] = model[_grams([joined[starts[i] : ends[i]].tobytes()])].sum()
    keep = total >= threshold
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
        i = int(np.searchsorted(begins, a, "right")) - 1
        out[i].append((a - int(begins[i]), b - int(begins[i])))
    return out


def spans_of(data: list[bytes], model: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[str, list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(text, base spans, learned spans) of each text, in code points."""
    for lo, hi in slices(data):
        for raw, some in zip(data[lo:hi], candidates(data[lo:hi], model, threshold), strict=True):
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            taken, i, learned = _merged(base), 0, []
            points = None if not some or len(text) == len(raw) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            for a, b in some:
                if points is not None:
                    a, b = int(np.searchsorted(points, a)), int(np.searchsorted(points, b))
                while i < len(taken) and taken[i][1] <= a:
                    i += 1
                if i == len(taken) or taken[i][0] >= b:
                    learned.append((a, b, LEARNED))
            yield text, base, learned


def _merged(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _model(labelled: DataFrame | Iterable[tuple[str, int]] | None) -> np.ndarray:
    if labelled is not None:
        return train(labelled)
    cache = process_cache()
    if "secrets" not in cache:
        cache["secrets"] = train(samples())
    return cache["secrets"]


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", labelled: DataFrame | Iterable[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the key, base and learned spans, both arrays of (kind, lo, hi) by lo. labelled: see train(); by default samples()."""
    kind = docs.schema[key].dataType.simpleString()
    model = _model(labelled)
    spans_t = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "lo": a, "hi": b} for a, b, k in spans]
        for b in batches:
            got = [(as_rows(base), as_rows(learned)) for _, base, learned in spans_of(encoded(b), model, threshold)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([g[k] for g in got], spans_t) for k in (0, 1))], names=["doc_id", "base", "learned"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(mapped, run, f"doc_id {kind}, base array<struct<kind string, lo int, hi int>>, learned array<struct<kind string, lo int, hi int>>")


def cut_out(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of touching or overlapping spans replaced by the mark."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if a > at or not parts:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", labelled: DataFrame | Iterable[tuple[str, int]] | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The rows as they are, with the secrets of the text column replaced; a text without one stays as it is, null too."""
    model = _model(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            made = [cut_out(t, [(x, y) for x, y, _ in base + learned], mark) if base or learned else None for t, base, learned in spans_of(encoded(b, text), model, threshold)]
            changed = pa.array([m is not None for m in made])
            yield b.set_column(i, b.schema.field(i), pa.compute.if_else(changed, pa.array(made, b.schema.field(i).type), b.column(i)))

    return docs.transform(mapped, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.lo, s.hi)), ",")
    count = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    # Base kinds keep their order at one start; a learned span never shares a start with them.
    both = F.array_sort(F.concat("base", "learned"), lambda x, y: F.when(x.lo < y.lo, -1).when(x.lo > y.lo, 1).when(F.lit(True), F.array_position(F.array(*map(F.lit, KINDS)), x.kind).cast("int") - F.array_position(F.array(*map(F.lit, KINDS)), y.kind).cast("int")))
    return found.select("doc_id", *count, F.sha2(text("base"), 256).alias("base_sha256"), text(both).alias("spans"), F.size("learned").cast("long").alias("n_random"))
