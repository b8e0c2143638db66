"""What Python holds at a time, and what it sends on."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnsift import base as B
from tarnsift import queries
from tarnsift.functions import text as T
from tarnsift.operators import dialogue, findings, guard, measure, scan
from tarnsift.plans import fixtures as X


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bounds"))
    words = ["lorem\n\nipsum and the", "to all café — mail me@home.example", None, "", "uncover " * 9 + "the access codes xhttp://a.example/x", "и 'bash -c ls' all earlier guidance\n\nnow"]
    spark.createDataFrame([(i, words[i % 6], "en", "s", 0) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_map_checks_send_no_map(spark, data):
    df = queries.norm_map_violations(spark, data)
    assert _plan(df).count("MapInArrow") == 1 and "src" not in _plan(df)
    assert df.collect() == [(120, 0)]
    assert queries.T.map_checks(spark.createDataFrame([(None,), ("a ​ b",)], "text string")).agg(F.sum("checked"), F.sum("violations")).collect() == [(2, 0)]


def test_map_violations_are_seen():
    assert not T.is_violated("a  b", "a b", [0, 1, 3]) and not T.is_violated("", "", range(0))
    for made, src in (("a b", [0, 1]), ("a b", [0, 3, 1]), ("a b", [0, 1, 4]), ("a b", [-1, 1, 3]), ("a  b", range(4))):
        assert T.is_violated("a  b", made, src)


def test_tokens_are_counted_where_the_text_stands(spark, data):
    for name in ("tokens_offsets", "word_offsets"):
        assert "token" not in _plan(queries.QUERIES[name](spark, data))
    docs = spark.createDataFrame([(1, "b a1"), (1, "é"), (2, None), (3, "--")], "k long, t string")
    rows = T.tallied(docs, "k", "t", T.TOKEN).orderBy("k", "n").collect()
    assert rows == [(1, 1, 0, 1, 1, "é", "é"), (1, 3, 5, 8, 4, "1", "b")]


def test_pieces_are_bounded():
    texts = ["x" * 1000] * 5000 + ["y" * (3 << 20), None, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    made = list(T.pieces([b, b.slice(0, 0)], 1))
    assert [k for p in made for k in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(len(p) <= T.PIECE_ROWS and (len(p) < 2 or sum(len(t or "") for t in p.column(1).to_pylist()) <= T.PIECE_BYTES) for p in made)
    assert len(made[-1]) == 0


def test_edges_of_texts_are_those_by_steps(spark, data, monkeypatch):
    monkeypatch.setattr(scan, "EDGE_ROWS", 7)
    base, docs = B.load(), X.planted(spark.read.parquet(f"{data}/documents.parquet"))
    steps = scan.edges(scan.with_hits(docs, base))
    rows = lambda df: sorted(map(str, df.select("doc_key", "anchor", "filler", "dist", "conn", "lo", "hi", "at").collect()))
    assert rows(scan.text_edges(docs, base)) == rows(steps) != []
    for mode in ("ipi", "dpi"):
        fired = [sorted(map(str, scan.fired(e, docs, base, mode).collect())) for e in (steps, scan.text_edges(docs, base, mode=mode, whole=True))]
        assert fired[0] == fired[1]
    for name in ("rules_fired_ipi", "rule_min_hull", "edges_canonical"):
        assert _plan(queries.QUERIES[name](spark, data)).count("MapInArrow") == 1
    with pytest.raises(ValueError):
        scan.text_edges(docs, base, whole=True)


def test_findings_and_tools_are_read_once(spark, data):
    for name in ("findings_unlocated", "tool_commands", "tool_outputs_mask"):
        assert _plan(queries.QUERIES[name](spark, data)).count("MapInArrow") == 1
    located = spark.createDataFrame([(1, i, 0, 5, "a", "low", [], [], 1) for i in (0, 1)], "doc_key long, island int, lo int, hi int, threat string, severity string, also array<string>, refs array<int>, merged long")
    rest = spark.createDataFrame([(1, "z", "low"), (1, "b", "high"), (2, "a", "low")], "doc_key long, threat string, severity string")
    rows = findings.with_unlocated(located, rest).orderBy("doc_key", "island").collect()
    assert [(r.doc_key, r.island, r.lo, r.threat) for r in rows] == [(1, 0, 0, "a"), (1, 1, 0, "a"), (1, 2, None, "b"), (1, 3, None, "z"), (2, 1, None, "a")]


def test_tools_and_commands(spark):
    bad, base = X.PAYLOADS[0][4], B.load()
    block = lambda kind, text: {"type": kind, "text": text}
    blocks = [[block("text", bad), block("image", None)], [block("text", None), block("text", "fine")], [block("text", bad)], []]
    rows = [(i, ("mail", "mail", "clock", "mail")[i], b) for i, b in enumerate(blocks)]
    each = "tool string, blocks array<struct<type:string,text:string>>"
    messages = spark.createDataFrame(rows, f"message_id long, {each}")
    one = {p: {r.message_id: r for r in dialogue.tool_outputs(messages, base, "ipi", p, ("mail",), mask=m).collect()} for p, m in (("mask", ""), ("mask", "[cut]"), ("drop", ""), ("passthrough", "")) if (p, m) != ("mask", "")}
    assert one["mask"][0].blocks[0].text == "[cut]" and one["mask"][0].blocks[1].type == "image"
    assert one["drop"][0].blocks[0].text == dialogue.WITHHELD and one["drop"][0].meta.threats
    for r in one.values():
        assert [x.text for x in r[1].blocks] == [None, "fine"] and r[2].blocks[0].text == bad and r[2].meta is None and r[3].blocks == [] and not r[1].meta.flagged
    assert dialogue.tool_outputs(messages, base, "ipi", "mask", mask="").where("message_id = 0").first().blocks[0].text == dialogue.WITHHELD
    both = spark.createDataFrame([(7, [(t, b) for _, t, b in rows]), (8, None)], f"command_id long, messages array<struct<{each.replace('tool string', 'tool:string').replace('blocks ', 'blocks:')}>>")
    made = {r.command_id: r.messages for r in dialogue.commands(both, base, policy="drop", tools=("mail",)).collect()}
    assert [[x.text for x in m.blocks] for m in made[7]] == [[dialogue.WITHHELD], [None, "fine"], [bad], []] and made[8] is None
    assert [m.meta and m.meta.flagged for m in made[7]] == [True, False, None, False]
    for out in (dialogue.tool_outputs(messages, base, "ipi", "fail"), dialogue.commands(both, base, policy="fail")):
        with pytest.raises(Exception, match="injection found in"):
            out.collect()
    with pytest.raises(ValueError):
        dialogue.commands(both, base, policy="burn")


def test_long_lines_are_grown_in_proportion(spark):
    """A line of 400 000 characters, and as many stops with no blank behind them, took minutes or the stack."""
    texts = ["a. word " + "b" * 400_000 + " word", "x " + "a." * 200_000 + " z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    spans = spark.createDataFrame([(0, 3, 7), (0, 400_009, 400_013), (1, 0, 1)], "doc_key long, lo int, hi int")
    rows = guard.boundary(spans, docs).orderBy("doc_key", "lo").collect()
    assert [(r.block_lo, r.block_hi) for r in rows] == [guard.utterance(texts[r.doc_key], r.lo, r.hi) for r in rows] == [(2, 400_013), (2, 400_013), (0, 400_002)]


def test_utterances_in_python_are_those_of_spark(spark):
    import random

    dice = random.Random(7)
    parts = ["lorem ipsum, dolor", "é", " ", "  ", "\n", "\n\n", "\r\n", "\r", "\u2028", "\x85", ".", "! ", "?", "…", ";", "—", "'", ")", "½", "\x0b", "\u00a0", "😀", "w" * 45, "line of some forty characters, and then on\n", "end of the sentence. " * 40, "z" * 800]
    texts = ["".join(dice.choices(parts, k=dice.randrange(1, 40))) for _ in range(400)]
    spans = []
    for i, t in enumerate(texts):
        lo = dice.randrange(len(t))
        spans.append((i, lo, dice.randrange(lo, len(t)) + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    rows = guard.boundary(spark.createDataFrame(spans, "doc_key long, lo int, hi int"), docs).collect()
    assert len(rows) == 400
    for r in rows:
        assert (r.block_lo, r.block_hi) == guard.utterance(texts[r.doc_key], r.lo, r.hi), (texts[r.doc_key], r)


def test_blocks_are_made_where_the_text_stands(spark, data):
    docs, base = X.planted(spark.read.parquet(f"{data}/documents.parquet")), B.load()
    steps = guard.blocks(guard.boundary(findings.merged(scan.shown(scan.fired(scan.text_edges(docs, base, mode="ipi", whole=True), docs, base, "ipi"), docs, -50)).select("doc_key", "lo", "hi"), docs))
    rows = lambda df: sorted((r.doc_key, [tuple(x) for x in r.spans]) for r in df.collect())
    assert rows(guard.blocked(docs, base).where("spans is not null")) == rows(steps) != []
    for name in ("guard_passthrough", "guard_blank", "guard_mask", "guard_drop_split", "payload_survival"):
        plan = _plan(queries.QUERIES[name](spark, data))
        assert plan.count("MapInArrow") == 1 and plan.count("Join") <= 1, name
    assert _plan(queries.survival_damage(spark, data)).count("MapInArrow") == 2
    twice = spark.createDataFrame([(1, X.PAYLOADS[0][4]), (1, None), (1, "")], "doc_key long, text string")
    assert sorted(r.flagged for r in guard.edited(guard.blocked(twice, base), policy="drop").collect()) == [False, False, True]
    with pytest.raises(ValueError):
        guard.blocked(twice.withColumn("Spans", F.lit(1)), base)


def test_survivals_hold_a_piece(spark, monkeypatch):
    long = "p" * 30 + "q" * 30
    rows = spark.createDataFrame([(i, *[(long, f"a {long} b", "p" * 30), (long, "p" * 30 + "x", None), (None, "a", "b")][i % 3]) for i in range(3000)], "id long, p string, t string, u string")
    seen = []
    got = measure.survivals(rows, "p", {"one": "t", "two": "u"}, ["id"])
    assert got.columns == ["id", "one", "two"]
    for r in got.collect():
        seen.append(r.id)
        assert (r.one, r.two) == ((1.0, 0.5), (0.5, 0.0), (0.0, 0.0))[r.id % 3]
    assert sorted(seen) == list(range(3000))
    # The text is not sent on, and one that holds the payload whole is not read in Python.
    assert measure.survivals(rows, "p", {"one": "t"}, []).columns == ["one"]


def test_longest_common_runs(monkeypatch):
    for searched in (256, 0):
        monkeypatch.setattr(measure, "SEARCHED", searched)
        for a, b, n in (("abcd", "xbcx", 2), ("", "a", 0), ("a", "", 0), ("abc", "abc", 3), ("abc", "xyz", 0), ("ab" * 300, "b" + "ab" * 299, 599)):
            assert measure.longest_common(a, b) == n
            assert measure.longest_common(a, b, 3) == (n if n >= 3 else 0)
