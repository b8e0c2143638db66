import numpy as np

from tarnsift.llm import embeddings


def brute(rows, cosine):
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        w = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(w / np.linalg.norm(w) if ok else None)
    n = len(rows)
    links, at = [0] * n, list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(n):
        for b in range(n):
            x, y = unit[a], unit[b]
            if a != b and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[a] += 1
                at[find(a)] = find(b)
            if x is not None and y is not None and rows[a][0] == rows[b][0]:
                at[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        c = min((rows[b][0] for b in range(n) if find(b) == find(a)), default=i) if i is not None and unit[a] is not None else i
        out.append((i, links[a], c, i is None or c == i))
    return sorted(out, key=str)


def check(spark, rows, block, kind="double"):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, row int").repartition(3)
    got = sorted([tuple(r) for r in embeddings.link(df, 0.9, block=block).collect()], key=str)
    assert got == brute(rows, 0.9)


def test_matches_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 8))
    rows = [(int(i) * 2 + 5, (centres[r.integers(12)] + r.normal(size=8) * r.choice([0, 0.1, 0.25])).tolist()) for i in range(150)]
    rows += [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0] * 7 + [float("nan")]), (6, [1.0] * 7 + [float("inf")]), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, rows[0][1]), (9000, [x * 1e200 for x in rows[0][1]]), (9001, [1.0, 2.0]), (9003, [2.0, 4.0])]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(501, rows[9][1])]
    check(spark, rows, 16)


def test_one_block_and_floats(spark):
    check(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], 2048, "float")


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.link(df).collect() == []
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.link(df).collect()] == [(1, 0, 1, True)]


def test_distant_blocks_are_skipped(spark):
    r = np.random.default_rng(3)
    rows = [(i, (np.eye(6)[i % 6] * 10 + r.normal(size=6) * 0.1).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    epsilon = np.sqrt(0.2)
    packed = embeddings.blocks(embeddings.classes(embeddings.prepared(df))[0], epsilon, 20)
    n = packed.count()
    assert embeddings.near_blocks(packed.select("block", "d", "lo", "hi"), epsilon).count() < n * (n + 1) / 4
