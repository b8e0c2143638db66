"""The stages and the whole pipeline against plain versions; names that clash, and empty tables."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline as P
from tarnsift.llm import packing, quality, secrets

from .test_neardup import brute
from .test_small import plain_mix

MORE = "_row int, _take int, _first int, row int, take int, nth int, slot int, epoch int, keep int, digest int, sig int, base int, ids int"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + MORE
EXTRA = tuple(range(100, 113))


def documents(seed=4):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(200)]
    texts = []
    for _ in range(40):
        base = r.choices(words, k=r.randint(20, 70))
        for _ in range(r.choice([1, 1, 2, 4])):
            w = list(base)
            w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += ["$$$ !!! ### " * 20 + str(i) for i in range(30)]
    texts += ["token = abcdefgh12345678 and the rest", "key xK9fQ2mZ7pL4vR8tB3nW6y here", None, "", " \n", "one", "One", "long " * 20000]
    rows = [(i + 1, t, "en", r.choice(["s1", "s1", "s2", None]), len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[2], (None, "no id", None, None, 5, *EXTRA), (None, texts[0], None, None, 5, *EXTRA)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int("$" not in (r[1] or "")), 0) for r in rows if r[0]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def plain_quality(spark, docs, d):
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return lambda rows: [r for r in rows if model.score(quality.statistics([(r[1] or "").encode()]))[0] >= quality.CUTOFF]


def plain_copies(rows):
    kept = {(i, c) for i, _, c, k in brute([r[:2] for r in rows], 5, 80, 100) if k}
    out, seen = [], set()
    for r in rows:
        if r[0] is None:
            out.append(r)
        elif any(i == r[0] for i, _ in kept) and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def plain_secrets(rows):
    model = secrets._model(None)
    out = []
    for r in rows:
        t = r[1]
        if t:
            _, base, learned = next(secrets.spans_of([t.encode()], model))
            t = secrets.cut_out(t, [(a, b) for a, b, _ in base + learned])
        out.append((r[0], t, *r[2:4], None if t is None else len(t), *r[5:]))
    return out


def plain_mixing(rows):
    """What mix() takes of each row; the schedule itself is compared in test_small."""
    from tarnsift.llm.mixing import BLOCK

    numbered = [(k, r[1], r[3]) for k, r in enumerate(rows)]
    names = {k: r[0] for k, r in enumerate(rows)}
    import hashlib
    import unittest.mock

    real = hashlib.md5
    # The plain schedule shuffles by the rows' own ids.
    texts = {f"{k}:".encode(): f"{'' if names[k] is None else names[k]}:".encode() for k in names}
    swap = lambda b: real(next((texts[p] + b[len(p) :] for p in [b.split(b":")[0] + b":"] if p in texts and len(b) > 32), b))
    with unittest.mock.patch("hashlib.md5", swap):
        slots, _, _ = plain_mix(numbered, BLOCK)
    take = {}
    for some in slots:
        for k, e, _, n, _ in some:
            take[k, e] = take.get((k, e), 0) + n
    out = []
    for (k, _), n in take.items():
        r = rows[k]
        t = r[1] if n >= len(r[1].split()) else " ".join(r[1].split()[:n])
        out.append((r[0], t, *r[2:4], len(t), *r[5:]))
    return out


def test_stages(spark, made):
    d, rows = made
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    stage = dict(P.STAGES)
    some = stage["quality"](spark, docs, d)
    assert some.columns == docs.columns
    want = plain_quality(spark, docs, d)(rows)
    assert key(some.collect()) == key(want) and 0 < len(want) < len(rows)
    assert all("$" not in (r[1] or "") for r in want)

    some = stage["near-duplicates"](spark, docs, d)
    assert some.columns == docs.columns and key(some.collect()) == key(plain_copies(rows))

    some = stage["secrets"](spark, docs, d)
    got = some.collect()
    assert some.columns == docs.columns and key(got) == key(plain_secrets(rows))
    assert sum("[SECRET]" in (r.text or "") for r in got) == 2

    distinct = plain_copies(rows)
    some = stage["mixing"](spark, spark.createDataFrame(distinct, COLUMNS).repartition(3), d)
    assert some.columns == docs.columns and key(some.collect()) == key(plain_mixing(distinct))

    pieces = stage["packing"](spark, docs, d).collect()
    known = packing.words()
    whole = {}
    for p in sorted(pieces, key=lambda p: p.start):
        whole.setdefault(p.doc_id, b"")
        whole[p.doc_id] += p.ids
    for r in rows:
        if r[0] not in (None, 3):
            assert whole[r[0]] == packing.tokens(r[1] or "", known).astype("<u4").tobytes()


def test_run_is_the_stages_in_turn_and_leaves_one_folder(spark, made):
    d, rows = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = spark.conf.get("spark.checkpoint.dir")
    from tarnsift.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    out = P.run(spark, d)
    assert len(set(os.listdir(at)) - before) == 1
    kept = plain_mixing(plain_secrets(plain_copies(plain_quality(spark, docs, d)(rows))))
    want, got, known = {}, {}, packing.words()
    for r in kept:
        ids = packing.tokens(r[1] or "", known)
        want[r[0]] = want.get(r[0], 0) + len(ids)
    for p in out.collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    sums = {}
    for p in out.collect():
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in sums.values())


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    none = spark.createDataFrame([], COLUMNS)
    none.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, none, d)
        assert out.columns == none.columns and out.count() == 0
    assert P.run(spark, d).count() == 0
    rows = documents()[:5]
    assert P.quality_stage(spark, spark.createDataFrame(rows, COLUMNS), d).count() == 5


def test_scores_are_numbers(spark, made):
    d, rows = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality.score(docs, quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in got)
