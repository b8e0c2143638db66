import random

import numpy as np
import pytest

from tarnsift.llm import neardup


def shingles(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, num, den):
    """Components over rows by every pair, rows of one doc_id joined."""
    sets = [shingles(t, k) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if rows[i][0] == rows[j][0] or den * len(a & b) >= num * len(a | b):
                at[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) if d is not None else None
        out.append((d, len(sets[i]), c, d is None or c == d))
    return sorted(out, key=str)


def check(spark, rows, k, num, den, **how):
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], "doc_id long, text string, component_id string, id string, _first string").repartition(3)
    got = sorted([tuple(r) for r in neardup.cluster(df, k, (num, den), **how).collect()], key=str)
    assert got == brute(rows, k, num, den)


def corpus(seed, groups, copies, edits=6):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 5))) for _ in range(300)]
    rows = []
    for _ in range(groups):
        base = r.choices(words, k=r.randint(30, 120))
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, 25, 8)
    rows += [(2, None), (5, ""), (8, " \t\n"), (11, "One"), (14, "one"), (17, "ONE two"), (20, "one two"), (None, rows[0][1]), (rows[0][0], rows[0][1]), (rows[0][0], "a fully different text of its own")]
    check(spark, rows, 3, 85, 100)


def hot(seed, n, edits, families=1):
    """Near copies of a text, in families that differ by about as much as a link allows."""
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w, f = list(base), i % families
        for at in range(f):
            w[30 * at + 5] = f"f{at}"
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"z{i}{r.random()}"
        rows.append((1000 - i, " ".join(w)))
    return rows


@pytest.mark.parametrize("few", [0, 8])
def test_large_bucket_in_blocks(spark, few):
    check(spark, hot(4, 130, 4), 3, 85, 100, block=40, few=few)
    check(spark, hot(5, 120, 3, 4), 3, 85, 100, block=30, few=few)


def test_words_that_collide_in_powers_of_two_stay_apart(spark):
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    one, two = s[:1024], s[1024:2048]
    check(spark, [(1, one), (2, two), (3, one.upper()), (4, f"x y {one}"), (5, f"x y {two}")], 3, 85, 100)


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", "other")], "doc_id string, text string")
    assert sorted(map(tuple, neardup.cluster(df, 3).collect())) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 1, "c", True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.cluster(df, 3, (85, 100)).collect() == []


def test_texts_without_a_pair(spark):
    check(spark, [(1, "a b c d e"), (2, "f g h i j"), (3, "long " * 30000)], 5, 80, 100)


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_bounds(t):
    b, r = neardup.band_rows(t)
    assert b * r <= neardup.HASHES and (1 - t**r) ** b <= neardup.BAND_MISS
    for n, m in neardup.least_matches(t):
        rng = np.random.default_rng(3)
        j = rng.beta(m, n - m + 2, 400_000)  # the posterior after m - 1 matches
        assert (j >= t).mean() < 5 * neardup.MISS + 1e-5


def test_verified_passes_over_rows_of_the_same_id(spark):
    from tarnsift.llm.common import shingle_sets

    words = "one two three four five six seven eight nine ten"
    a, b = words + " aaa", words + " bbb"
    digest = lambda t: bytes(neardup._digest(shingle_sets([t.encode()], 3)[0]))
    kind = "binary"
    for first in ("x" * len(a), None):
        texts = spark.createDataFrame([(1, digest(a), first), (1, digest(a), a), (2, digest(b), b)], f"id long, digest {kind}, text string").coalesce(1)
        pairs = spark.createDataFrame([(1, 2)], "a long, b long")
        assert [tuple(r) for r in neardup.verified(pairs, lambda rows: rows.join(texts, "id"), 3, (80, 100)).collect()] == [(1, 2)]


def test_components_of_both_ways(spark):
    from tarnsift.llm.graph import components

    r = random.Random(9)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            at[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    for few in (0, 1 << 20):
        assert {tuple(x) for x in components(df, one_task=few).collect()} == {(x, find(x)) for x in at}
