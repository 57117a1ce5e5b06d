import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from lattica.llm import chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|say|>b", ""]), st.text(alphabet="<|\\>turnsayend x\n[/INST]é", max_size=40)), max_size=5))
def test_round_trip(turns):
    pieces = [chat.piece(*t) for t in turns]
    assert chat.read_pieces("".join(p[0] for p in pieces)) == turns
    for (text, lo, hi), (role, said) in zip(pieces, turns, strict=True):
        assert chat.unescape(text[lo:hi]) == (said if role == "assistant" else "")


def test_layouts():
    want = [("user", "hi"), ("assistant", "yo")]
    for record in (
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "extra": {"a": [1]}},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "response": "yo"},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"output": "yo", "instruction": "hi"},
    ):
        assert chat.turns_of(record) == want
    assert chat.turns_of({"foo": 1}) is None and chat.turns_of([1]) is None


def by_hand(turns):
    h, loss = hashlib.sha256(), "".join(t or "" for r, t in turns if r == "assistant")
    for r, t in turns:
        h.update(f"{r or ''}\n{t or ''}\n".encode())
    return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_frames(spark):
    rows = [(1, 0, "user", "a <|end|>"), (1, 1, "assistant", None), (1, 1, None, "tie"), (2, 5, "assistant", "x" * 5000), (None, 0, "user", "u"), (3, 0, "user", "dup"), (3, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.selectExpr("*", "1 as seq", "'x' as formatted")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_rows(clash)).collect()}
    want = {1: [("user", "a <|end|>"), (None, "tie"), ("assistant", None)], 2: [("assistant", "x" * 5000)], None: [("user", "u")], 3: [("user", "dup")] * 2}
    assert got == {k: by_hand(v) for k, v in want.items()}
    assert chat.digests(chat.format_rows(df.limit(0))).count() == 0


def test_records(spark):
    rows = [(1, json.dumps({"prompt": "p", "response": "r"})), (2, "not json"), (3, None), (4, json.dumps({"odd": 1}))]
    out = chat.format_records(spark.createDataFrame(rows, "k long, j string"), "k", "j").collect()
    assert [(r["conv_id"], r["seq"]) for r in out] == [(1, 0), (1, 1)]


def test_records_of_mixed_layouts_lose_nothing(spark):
    say = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]
    want = [("user", "hi"), ("assistant", "yo")]
    assert chat.turns_of({"conv_id": 1, "text": "t", "messages": say}) == want
    assert chat.turns_of({"system": "s", "messages": say}) == [("system", "s"), *want]
    assert chat.turns_of({"system": "s", "instruction": "hi", "input": "i", "output": "yo"}) == [("system", "s"), ("user", "hi"), ("user", "i"), ("assistant", "yo")]
    assert chat.turns_of({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, say[1]]}) == want
    assert chat.turns_of({"messages": [], "system": "s"}) == [("system", "s")] and chat.turns_of({"messages": []}) == []
    rows = [(1, json.dumps({"conv_id": 1, "messages": say})), (2, "not json"), (3, None), (4, json.dumps({"odd": 1})), (5, json.dumps({"messages": []}))]
    df = spark.createDataFrame(rows, "k long, j string")
    assert sorted(r["seq"] for r in chat.format_records(df, "k", "j").collect()) == [0, 1]
    assert {(r["conv_id"], r["record"]): r["status"] for r in chat.unmatched(df, "k", "j").collect()} == {rows[1]: "not JSON", rows[2]: "null", rows[3]: "unknown layout", rows[4]: "no turns"}
    extra = spark.createDataFrame([(1, 0, "user", "hi", "p", "o")], "conv_id long, turn long, role string, text string, prompt string, output string")
    assert [r["seq"] for r in chat.format_rows(extra).collect()] == [0]


def test_query(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op1_chat_format(spark, "/root/testdata/sf0.001").collect()}
    turns = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got == {k: by_hand(v) for k, v in turns.items()}


def test_long_conversations_and_empty_tables(spark, tmp_path):
    rows = [(7, i, ["user", "assistant"][i % 2], f"turn {i} <|end|>") for i in range(3000)] + [(8, 0, "assistant", "é<|" * 100_000)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    assert got[7] == by_hand([(r, t) for c, _, r, t in rows if c == 7]) and got[8] == by_hand([("assistant", rows[-1][3])]) and set(got) == {-1, 7, 8}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r["conv_id"] for r in chat.op1_chat_format(spark, f"{tmp_path}/none").collect()] == [-1]
