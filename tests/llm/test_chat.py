import hashlib
import itertools

from quernstone.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip(spark):
    odd = ["", "\\", "\\b", "<turn:user>", "</turn>\n", "</turn>", "<also>", "\\l/turn>", "a\\", "<", "</tur", "n>\nx", "<turn:", "é\n\n🙂", "\\\\l\\g>", ">", "<<also>>", "x</turn>\n<turn:assistant>y"]
    rows, k = [], 0
    for a, b in itertools.product(odd, odd):
        rows += [(k, 0, "user", a), (k, 1, "assistant", b), (k, 2, "assistant", a), (k, 3, "user", b), (k, 4, b or None, None), (k, 5, "assistant", a + b)]
        k += 1
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    out = C.formatted(df)
    by = {}
    for c, _, r, t in rows:
        by.setdefault(c, []).append((r or "", t or ""))
    got = C.read_back(out).collect()
    assert len(got) == len(by)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == by[r.conv_id]
        assert r.learned == [t for role, t in by[r.conv_id] if role == "assistant"]
    first = out.filter("conv_id = 13").first()
    assert first.formatted.count("</turn>\n") == len([1 for _ in itertools.groupby(by[13], key=lambda x: x[0])])
    assert len(first.formatted) == C.read_back(out).filter("conv_id = 13").first().formatted_chars


def test_template(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "yes", ""), (1, 1, "user", "b", ""), (1, 0, "user", "a<also>", "")], SCHEMA)
    r = C.formatted(df).first()
    assert r.formatted == "<turn:user>a\\lalso><also>b</turn>\n<turn:assistant>yes</turn>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["yes"]


def test_order_nulls_and_empty(spark):
    rows = [(None, 1, "user", "x", ""), (None, 0, None, None, None), (5, None, "assistant", "z", ""), (5, 0, "assistant", "y", ""), (5, 0, "assistant", "y", ""), (5, 0, "assistant", "a", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.conv_id or 0, [(t.role, t.text) for t in r.turns]) for r in C.read_back(C.formatted(df)).collect()), key=str)
    assert got == [(0, [("", "")]), (0, [("user", "x")]), (5, [("assistant", t) for t in ("z", "a", "y", "y")])]
    assert C.read_back(C.formatted(df.limit(0))).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>"), (1, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in C.op9_chat(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, -7}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi\nassistant\n</turn>\nassistant\n\n") and got[1].loss_sha256 == sha("</turn>")
    assert got[-7].turns_sha256 == sha(f"user\n{C.TRICKY}\nassistant\n{C.TRICKY}\n") and got[-7].loss_chars == len(C.TRICKY)


def test_a_long_conversation(spark):
    """20,000 turns of one conversation, half of them adjacent to another of their role."""
    df = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 4 < 2, 'user', 'assistant') AS role", "concat('t', id) AS text")
    (r,) = C.read_back(C.formatted(df)).collect()
    assert [t.text for t in r.turns] == [f"t{k}" for k in range(20_000)]
    assert r.learned == [f"t{k}" for k in range(20_000) if k % 4 > 1]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "a", "b")], "conv_id long, turn long, role string, text string, alone string, `t.u` string")
    assert C.read_back(C.formatted(df)).first().turns[0].text == "x"
