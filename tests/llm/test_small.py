"""Edge cases and brute force of the operators that work row by row, and of mixing, packing and licences."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tarnsift.llm import langid, licenses, media, mixing, neardup, packing, pii, quality, secrets

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "é" * 50), (5, "word " * 20000), (5, "word " * 20000), (None, "null id"), (6, "mail a@b.cc, +49 (30) 123 456 78 at 10.0.0.1 and 4111 1111 1111 1111.")]


def frame(spark, rows, more="lang string, source string, row long, kind string"):
    return spark.createDataFrame([(*r, "en", "s", 9, "k") for r in rows], "doc_id long, text string, " + more).repartition(2)


def test_odd_rows(spark):
    df = frame(spark, ODD)
    none = spark.createDataFrame([], df.schema)
    model = langid.train(df)
    forest = quality.train(df, spark.createDataFrame([(1, 1), (4, 0), (6, None)], "doc_id long, quality int"))
    for run in (lambda d: langid.identify(d, model), pii.detect, lambda d: media.features(media.store(d)), secrets.detect, secrets.redact, licenses.find, lambda d: quality.score(d, forest)):
        assert run(df).count() == len(ODD)
        assert run(none).count() == 0
    assert packing.pack(none).count() == 0 and mixing.mix(none).count() == 0
    assert {r.doc_id for r in packing.pack(df).collect()} == {r[0] for r in ODD}
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select cast(id as long) as doc_id, cast(unhex(x) as string) as text, 'a' as source, 'en' as lang from values (1, '61ff20e2'), (2, '6162') as t(id, x)")
    model = langid.train(df)
    forest = quality.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    for run in (lambda d: langid.identify(d, model), pii.detect, lambda d: media.features(media.store(d)), secrets.detect, secrets.redact, licenses.find, packing.pack, lambda d: quality.score(d, forest), lambda d: neardup.cluster(d, 3)):
        assert run(df).count() >= 2


# Plain forms of the fixed patterns, each tried at every place.
def plain(text, pattern, flags=0):
    out, at, p = [], 0, re.compile(pattern, flags)
    while m := p.search(text, at):
        out.append(m.span())
        at = max(m.end(), at + 1)
    return out


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def noise(seed, alphabet, n=400):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(n)]


def test_personal_base_spans():
    for t in noise(1, "ab0123.@-+ () 49") + [r[1] or "" for r in ODD]:
        want = [("email", *s) for s in plain(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
        want += [("ip", a, b) for a, b in plain(t, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in t[a:b].split("."))]
        digits = lambda a, b: re.sub("[^0-9]", "", t[a:b])  # noqa: B023, E731
        want += [("card", a, b) for a, b in plain(t, r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(a, b)) <= 19 and luhn(digits(a, b))]
        want += [("phone", a, b) for a, b in plain(t, r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(a, b)) <= 15]
        assert pii.base_spans(t) == want


def test_secret_base_spans():
    r = random.Random(3)
    texts = ["".join(r.choice(["Token", "api_key", "apikey", "PassWord", '"', "'", " ", ":", "=", "abcdef01", "AKIA", "ZZ99", "İ", "f" * 20]) for _ in range(r.randint(1, 14))) for _ in range(500)]
    for t in texts:
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        want += [(a, b, "access") for a, b in plain(t, "AKIA[A-Z0-9]+") if b - a >= 16]
        want += [(a, b, "hex") for a, b in plain(t, "[0-9a-f]+") if b - a >= 32]
        assert secrets.base_spans(t) == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def plain_ratio(s, labelled):
    """The log-likelihood ratio by counting strings of one to three signs, character by character."""
    n = len(secrets.ALPHABET) + 1
    seen = [{}, {}]
    for t, y in labelled:
        padded = [None, None, *(c if c in secrets.ALPHABET else None for c in t)]
        for i in range(2, len(padded)):
            two, one, c = padded[i - 2] if padded[i - 1] is not None else None, padded[i - 1], padded[i]
            for k in ((two, one, c), (one, c), (c,), ("after", two, one), ("after", one), ("all",)):
                seen[y][k] = seen[y].get(k, 0) + 1
    total, padded = 0.0, [None, None, *(c if c in secrets.ALPHABET else None for c in s)]
    for i in range(2, len(padded)):
        two, one, c = padded[i - 2] if padded[i - 1] is not None else None, padded[i - 1], padded[i]
        p = []
        for y in (0, 1):
            of = lambda *k: seen[y].get(k, 0)  # noqa: B023, E731
            x = (of(c) + 0.5) / (of("all") + 0.5 * n)
            x = (of(one, c) + secrets.SMOOTH * x) / (of("after", one) + secrets.SMOOTH)
            p.append((of(two, one, c) + secrets.SMOOTH * x) / (of("after", two, one) + secrets.SMOOTH))
        total += np.log(p[1] / p[0])
    return total


def test_secret_models(spark):
    labelled = secrets.samples(1, 400)
    model = secrets.train(labelled)
    for s in ["xK9fQ2mZ7pL4vR8t", "international_name", "A", "", "--==", "12345678", "abc/Def+9"]:
        assert abs(secrets.ratio(s, model) - plain_ratio(s, labelled)) < 1e-6, s
    df = spark.createDataFrame([*labelled, (None, 1), ("x", None)], "text string, label int").repartition(3)
    assert np.allclose(secrets.train(df), model)
    assert secrets.cut_out("ab12cd", [(1, 3), (2, 4)], "#") == "a#cd"


def learned(texts, model):
    return [[(a, b) for a, b, _ in found] for _, _, found in secrets.spans_of([t.encode() for t in texts], model)]


def test_learned_spans_recall():
    model, r = secrets.train(secrets.samples(1)), random.Random(12)
    share = lambda keys: np.mean([got == [(5, 5 + len(s))] for s, got in zip(keys, learned([f"sé\ne {s} there" for s in keys], model), strict=True)])
    upper, lower, digits = secrets.ALPHABET[:26], secrets.ALPHABET[26:52], secrets.ALPHABET[52:62]
    for letters in (upper + lower + digits, upper + lower, upper, lower):
        for n in (16, 20, 24, 32, 48):
            keys = ["".join(r.choices(letters, k=n)) for _ in range(500)]
            # Of letters of one case alone, short keys look like words more often.
            assert share([s for s in keys if not secrets.base_spans(s)]) > (0.94 if n >= 20 or len(letters) > 26 else 0.75), (letters, n)
    plain = [s for s, y in secrets.samples(2, 4000) if not y]
    assert share(plain) < 0.0005
    assert learned(["qWeRtYuIoPaSdFgHjKlZxCvBnM", "“xK9fQ2mZ7pL4vR8t”", "4111111111111111 and 20240229"], model) == [[(0, 26)], [(1, 17)], []]


def test_learned_spans_beside_base_spans():
    model, key = secrets.train(secrets.samples(1)), "xK9fQ2mZ7pL4vR8tB3nW6y"
    texts = [f"token = {key}", f"{key} token = {key} {key}", "", "a" * 100_000 + " " + key]
    base = [[(a, b) for a, b, _ in secrets.base_spans(t)] for t in texts]
    assert base[0] == [(0, 30)] and learned(texts, model) == [[], [(0, 22), (54, 76)], [], [(100_001, 100_023)]]


def test_contexts_find_unseen(spark):
    rows = [(i, f"please call our desk on +49 30 55{i:04d}7 today") for i in range(30)] + [(99, "please call our desk on 0049 30 777")]
    rows += [(100, "please call our desk on 0049-30-777 today")]
    got = {r.doc_id: r for r in pii.detect(frame(spark, rows)).collect()}
    assert all(len(got[i].base) == 1 and not got[i].learned for i in range(30))
    assert [(s.lo, s.hi) for s in got[99].learned] == [(24, 35)] and [(s.lo, s.hi) for s in got[100].learned] == [(24, 35)]


def plain_contexts(texts, support=3, confidence=0.8, most=8):
    """The learned spans by plain loops over words."""
    signs = ".,;:!?()[]{}\"'"
    docs = []
    for t in texts:
        words = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            a, b = m.span()
            while a < b and t[a] in signs:
                a += 1
            while b > a and t[b - 1] in signs:
                b -= 1
            if a < b:
                words.append((a, b, m.group()[-1] in ".,;!?"))
        spans = pii._merged(pii.base_spans(t))
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t[a:b]) for a, b, _ in words]
        docs.append((t, words, low, spans, [any(a < y and x < b for x, y in spans) for a, b, _ in words]))
    left = lambda low, i: ("L", *low[max(0, i - 2) : i]) if i else None
    right = lambda low, i: ("R", *low[i : i + 2]) if i < len(low) else None
    digit = lambda s: any(c in "0123456789" for c in s)
    letters = lambda s: not digit(s) and not any(c in "@_+=/\\#:." for c in s[1:-1])
    edges, seeds, places = {}, {}, []
    for d, (t, words, low, spans, seeded) in enumerate(docs):
        for a, b in spans:
            i, j = sum(y <= a for _, y, _ in words), sum(x < b for x, _, _ in words)
            for c in (left(low, i), right(low, j)):
                if c:
                    seeds.setdefault(c, set()).add(t[a:b])
                    edges.setdefault(c, []).append((t[a:b], True, False))
        text = lambda lo, hi: t[words[lo][0] : words[hi - 1][1]]  # noqa: B023, E731
        has = lambda k: digit(text(k, k + 1))  # noqa: B023, E731
        for i in range(len(words)):
            if not seeded[i]:
                lo, hi = i, i + 1
                while has(i) and hi < len(words) and hi - i < most and has(hi) and not seeded[hi] and not words[hi - 1][2]:
                    hi += 1
                places.append((d, left(low, i), None, i, hi, True))
                while has(i) and lo > 0 and i + 1 - lo < most and has(lo - 1) and not seeded[lo - 1] and not words[lo - 1][2]:
                    lo -= 1
                places.append((d, None, right(low, i + 1), lo, i + 1, True))
                for hi in range(i + 1, min(len(words), i + most) + 1):
                    if any(seeded[i:hi]):
                        break
                    places.append((d, left(low, i), right(low, hi), i, hi, False))
    of = lambda p: docs[p[0]][0][docs[p[0]][1][p[3]][0] : docs[p[0]][1][p[4] - 1][1]]
    plain = lambda p: all(letters(docs[p[0]][0][a:b]) for a, b, _ in docs[p[0]][1][p[3] : p[4]])
    for p in places:
        for c in p[1:3]:
            if c and p[5]:
                edges.setdefault(c, []).append((of(p), False, plain(p)))
    able = {c for c, v in seeds.items() if len(v) >= support}
    sure = {v for c in able for v, seed, _ in edges[c] if seed}
    belief = {}
    while True:
        score = {c: np.mean([1.0 if v in sure else belief.get(v, 0.0) for v, _, _ in edges[c]]) for c in able}
        now = {}
        for c in able:
            for v, _, word in edges[c]:
                if not word and score[c] >= confidence:
                    now[v] = max(now.get(v, 0), score[c])
        if all(abs(now[v] - belief.get(v, 0)) < 1e-9 for v in now):
            break
        belief = now
    holds = {c for c in able if score[c] >= confidence}
    out = [set() for _ in texts]
    two = {}
    for p in places:
        if p[5] and not plain(p) and (p[1] in holds or p[2] in holds):
            out[p[0]].add((p[3], p[4]))
        if not p[5] and p[1] in holds and p[2] in holds:
            two[p[0], p[3]] = min(p[4], two.get((p[0], p[3]), 1 << 30))
    for (d, lo), hi in two.items():
        out[d].add((lo, hi))
    spans = [{(docs[d][1][a][0], docs[d][1][b - 1][1]) for a, b in s} for d, s in enumerate(out)]
    return [sorted(x for x in s if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in s)) for s in spans]


def test_contexts_match_plain_loops(spark):
    r = random.Random(6)
    texts = []
    for i in range(250):
        some = []
        for _ in range(r.randint(1, 4)):
            some += r.choices(["the", "é", "of", "and", "“so”", "it's", "(well)", "n.a.", "12"], k=r.randint(0, 3))
            phone, mail = [f"+49 30 5{r.randrange(10**6):06d}", *[f"+49 30 5{r.randrange(50):06d}"] * 14, f"0049-{r.randrange(99)}-7", f"{r.randrange(999)} {r.randrange(99)},"], [f"u{r.randrange(99)}@mail.example", *[f"u{r.randrange(999)}@mail.example"] * 12, "ann@localhost"]
            some += r.choice([["call", "me", "on", r.choice(phone)], ["Mail", "to:", r.choice(mail), "today", "or", "never."], ["Mail", "to:", r.choice([*mail, "Anna"]), "today", "or"], ["I", "am", r.choice([*phone, *mail, "Anna", "a", "b"])], [r.choice(mail), "please", "do"], [r.choice(["10.0.0.1", "Otto"])]])
        texts.append(" ".join(some))
    texts += ["", " ", "call me on", "on 12"]
    got = {x.doc_id: [(s.lo, s.hi) for s in x.learned] for x in pii.detect(frame(spark, list(enumerate(texts)))).collect()}
    want = plain_contexts(texts)
    assert any(want) and [got[i] for i in range(len(texts))] == want


def test_contexts_mark_any_shape(spark):
    rows = [(i, f"please call our desk on +49 30 55{i:04d}7 today") for i in range(30)] + [(100 + i, f"write to me at user{i}@mail.example or come") for i in range(30)]
    unseen = {50: ("please call our desk on ", "0049 30 777", ""), 51: ("please call our desk on ", "0049-30-777", " today"), 52: ("call our desk on ", "555-123-4567", ", thanks"), 53: ("Please write to me at ", "ann2@localhost", ""), 54: ("write to me at ", "Ann at home", " or come"), 55: ("our desk on ", "4711", " today")}
    rows += [(i, "".join(p)) for i, p in unseen.items()] + [(60, "call our desk on Monday"), (61, "desk 0049-30-777 on")]
    got = {r.doc_id: [(s.lo, s.hi) for s in r.learned] for r in pii.detect(frame(spark, rows)).collect()}
    assert {i: v for i, v in got.items() if v} == {i: [(len(a), len(a) + len(b))] for i, (a, b, _) in unseen.items()}


def test_media_round_trip(spark):
    for r in media.features(media.store(frame(spark, ODD))).collect():
        t = next((x[1] or "").encode() for x in ODD if x[0] == r.doc_id)
        p = media.payload_of(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    png = bytearray(media.encode(np.zeros((2, media.WIDTH), np.uint8)))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(png))


@pytest.mark.parametrize("kind", range(5))
def test_unfilter(kind):
    r = np.random.default_rng(kind)
    want = r.integers(0, 256, (7, 12), dtype=np.uint8)
    above = np.vstack([np.zeros((1, 12), np.uint8), want[:-1]]).astype(int)
    left = np.hstack([np.zeros((7, 1), int), want[:, :-1].astype(int)])
    corner = np.hstack([np.zeros((7, 1), int), above[:, :-1]])
    p = left + above - corner
    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
    guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
    assert (media.unfilter(np.full(7, kind), ((want.astype(int) - guess) % 256).astype(np.uint8)) == want).all()


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(50 + i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta's", "12", "\n\n", "été"], k=i * 7))) for i in range(60)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(frame(spark, rows)).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(by_doc[i], key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in got]).tolist() == ids
        assert all(p.doc_tokens == len(ids) for p in got) and got[0].start == 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0


def test_added_tokens_inside_texts():
    from tokenizers import Tokenizer
    import public_tokenizers

    t, known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.words()
    r, end = random.Random(4), "<|endoftext|>"
    texts = [f"a {end} b", end, end * 2, f"x{end}y"] + ["".join(r.choices([end, " ", "  ", "\n", "\t", "word", "12", "<|", "é"], k=r.randint(1, 20))) for _ in range(500)]
    for x in texts:
        assert packing.tokens(x, known).tolist() == [*t.encode(x, add_special_tokens=False).ids, 0], x
    letters = "abcdefgßéÀÿāŐƀɏɐΩжª'’"
    for x in (" ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(20)) for _ in range(300)):
        assert packing.tokens(x, known).tolist() == [*t.encode(x, add_special_tokens=False).ids, 0], x


def test_mixing_keeps_rows_when_splits_change(spark, tmp_path):
    at, r = str(tmp_path / "docs"), random.Random(8)
    spark.createDataFrame([(i, " ".join(["w"] * (i % 50 + 1)), r.choice("ab")) for i in range(400)], "doc_id long, text string, source string").repartition(8).write.parquet(at)
    name = "spark.sql.files.openCostInBytes"
    df = spark.read.parquet(at)
    t = {x.source: x.target for x in mixing.targets(mixing.sized(df).groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "source_size")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 30))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set(name, "1")
    try:
        mixed = mixing.mix(df, block=64)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        got = {}
        for x in mixed.collect():
            got[x.source] = got.get(x.source, 0) + len(x.text.split())
    finally:
        for c in (name, "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(c)
    assert all(abs(got[s] - t[s]) <= 64 * 4 for s in t)


def plain_mix(rows, block, golden=mixing.GOLDEN):
    """Slots as lists of (row, epoch, start, words), by walking the schedule word by word."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, list(names)
    while open_:
        left = sum(whole.values()) - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * whole[s]]
        target |= {s: 3 * whole[s] if over else left * weight[s] / sum(weight[x] for x in open_) for s in over or open_}
        open_ = [s for s in open_ if s not in target]
    goal = [int(target[s] + 0.5) for s in names]
    edges = np.cumsum(np.array(goal, float)) / max(1, sum(goal))
    digest = lambda d, t: hashlib.md5(f"{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    stream = {s: [(k, e, w) for e in range(3) for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: digest(*rows[k][:2])) for w in range(size[k])] for s in names}
    out, at = [], dict.fromkeys(names, 0)
    for t in range(-(-sum(goal) // block)):
        s = names[min(int(np.searchsorted(edges, (t + 0.5) * golden % 1, side="right")), len(names) - 1)]
        words = stream[s][at[s] : at[s] + block]
        at[s] += block
        spans = {}
        for k, e, w in words:
            spans.setdefault((k, e), []).append(w)
        out.append(sorted((rows[k][0], e, w[0], len(w), " ".join((rows[k][1] or "").split()[w[0] : w[0] + len(w)])) for (k, e), w in spans.items()))
    return out, target, whole


def test_mixing_follows_the_schedule(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices("abcdef", k=r.choice([0, 3, 40, 300]))) if i % 17 else None, r.choice(["a", "b", "b", "b", None])) for i in range(300)] + [(900 + i, "x y z", "tiny") for i in range(9)]
    df = spark.createDataFrame([(*x, "keep me", 1, 2, 3) for x in rows], "doc_id long, text string, source string, row string, take int, epoch int, slot int").repartition(5)
    want, target, whole = plain_mix(rows, 16)
    got = [[] for _ in want]
    for x in mixing.blocks(df, block=16).collect():
        got[x.slot].append((x.doc_id, x.epoch, x.start, x.words, x.text))
    assert [sorted(x) for x in got] == want
    assert plain_mix(rows, 16, 0.1234567)[0] != want
    mixed = mixing.mix(df, block=16).collect()
    assert all((x.row, x["take"], x.epoch, x.slot) == ("keep me", 1, 2, 3) for x in mixed)
    taken = {}
    for x in mixed:
        taken[x.source] = taken.get(x.source, 0) + len(x.text.split())
    assert all(abs(taken[s] - target[s]) <= min(3 * 16, mixing.deviation(len(want)) * 16) and taken[s] <= 3 * whole[s] for s in whole)
    first = {}
    for t, some in enumerate(want):
        for d, e, *_ in some:
            first.setdefault((d, e), t)
    assert sorted(x.doc_id for x in mixed) == sorted(d for d, _ in first)
    order = {}
    for (d, e), t in sorted(first.items(), key=lambda x: x[1]):
        order.setdefault(d, []).append(t)
    seen = [order[x.doc_id].pop(0) for x in mixed]
    assert seen == sorted(seen)


def test_mixing_of_nothing_and_of_one_digest(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], kind)).count() == 0
    rows = [(None, "same words here", None)] * 200 + [(None, "other", "a")]
    got = mixing.mix(spark.createDataFrame(rows, kind).repartition(4), block=8).collect()
    assert 190 <= sum(x.text == "same words here" for x in got) <= 205 and sum(x.source == "a" for x in got) <= 3


def test_licences(spark):
    full = dict(licenses.KNOWN[-8:])
    lower = full["GPL-3.0"].lower().replace("license", "licence").replace(",", " ,").replace("\n", " \n\n")
    rows = [
        (1, licenses.MIT.upper().replace(" ", "\n "), "MIT"),
        (2, "Copyright (c) 2020 Someone\n" + licenses.ISC, "ISC"),
        (4, licenses.MIT + " more", None),
        (5, "MIT License Copyright (c) 2019-2021, 2023 by X Y Inc. and others " + licenses.MIT.replace("\n", " "), "MIT"),
        (6, "MIT License\n\nCopyright 2020 A. B. Some\nAll rights reserved.\n" + licenses.MIT, None),
        (7, lower, "GPL-3.0"),
        (8, full["Apache-2.0"].split(licenses.END)[0] + licenses.END.title(), "Apache-2.0"),
        (9, full["LGPL-2.1"] + "\n" * 50, "LGPL-2.1"),
        (10, full["CC0-1.0"].replace("acknowledgment", "acknowledgement"), "CC0-1.0"),
        (11, full["MPL-2.0"], "MPL-2.0"),
        (12, "copyright 2020 " + " " * 100_000 + "x", None),
        (13, "all rights reserved", None),
        (14, full["GPL-2.0"][:-400], None),
        (15, "Copyright (c) 2020 Who. " + licenses.ZLIB, "Zlib"),
    ]
    got = {r.doc_id: r for r in licenses.find(frame(spark, [r[:2] for r in rows])).collect()}
    assert {i: got[i].license for i, *_ in rows} == {i: want for i, _, want in rows}
    noted = licenses.find(frame(spark, [(3, "intro\nLicenced under the MIT License!\nend of it, under no licence"), (4, None), (5, "")])).collect()
    assert [(r.notices, r.n_notices) for r in sorted(noted, key=lambda r: r.doc_id)] == [("MIT", 1), ("", 0), ("", 0)]
    own = spark.createDataFrame([("B", "Do as you like."), ("A", "do AS you like"), ("C", "")], "license string, text string")
    assert [r.license for r in licenses.find(frame(spark, [(1, "do as you like!"), (2, "!")]), own).orderBy("doc_id").collect()] == ["A", None]
    assert "python" not in licenses.find(frame(spark, [(1, "x")]))._jdf.queryExecution().toString().lower()


def test_line_marks_miss_no_notice():
    assert all(any(m in t.lower() for m in licenses.MARKS) for _, t in licenses.KNOWN if len(t) < 2 * licenses.LINE)


def test_trees_learn():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = quality.grow(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    one = quality.grow(x[:5], np.ones(5))
    assert (one.score(x[:3]) > 0.99).all()
