import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelwright.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<\\/s>", "a\nb", "", "<<ROLE>>x<</ROLE>>", "[INST] ", " [/INST]", "<s>", "[", "<", "<<s>>", "ends with \\", "漢字 🎉 [/INST]", "<</SYS>>"]


def test_every_text_comes_back(spark):
    rows = [(k, t, role, text) for k, role in enumerate(("user", "assistant", "system", "od\\d [INST]", "")) for t, text in enumerate(NASTY)]
    rows += [(9, t, ("user", "assistant", "assistant", "x")[t % 4], text) for t, text in enumerate(NASTY * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.turns_of_rows(df)).withColumn("back", chat.read_back(F.col("text"))).withColumn("learnt", chat.masked(F.col("text"), F.col("loss")))
    for r in out.collect():
        own = [(x[2], x[3]) for x in sorted(rows) if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.back] == own
        assert r.learnt == "".join(text for role, text in own if role == "assistant")


def test_rows_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "b"), (1, 0, "user", None), (None, 5, "assistant", "x"), (2, None, "user", "late"), (2, -1, "user", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as loss", "'a' as fingerprint")
    got = {r.conv_id: [(t.role, t.text[:5]) for t in r.turns] for r in chat.turns_of_rows(df).collect()}
    assert got == {1: [("", "b"), ("user", ""), ("user", "")], None: [("assistant", "x")], 2: [("user", "late"), ("user", "yyyyy")]}
    assert chat.turns_of_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_rows(df.drop("role"))


def test_rows_come_back_through_records_of_mixed_layouts(spark):
    """Whatever layout a conversation is written in, its fingerprint finds the mapping that gives the same turns."""
    import random

    rng = random.Random(3)
    rows = [(k, t, role, rng.choice([*NASTY, "plain", "\x00 \" quote", None, "x" * 2000])) for k in range(160) for t, role in enumerate(rng.choice([("user", "assistant"), ("system", "user", "assistant"), ("user", "assistant", "user"), ("system",), ("human", "gpt"), ("user", None, "tool"), ("assistant", "user"), ("System", "user", "assistant")]))]
    rows += [(k, t, role, f"text {k}") for k in range(200, 260) for t, role in enumerate(("system", "user", "assistant", "user")[k % 2 : 3 + k % 3 // 2])]
    df = spark.createDataFrame([*rows, (None, 0, "user", "no id")], "conv_id long, turn long, role string, text string")
    want = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.turns_of_rows(df).collect()}
    out = chat.turns_by_layout(df).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == want
    assert {r.mapping for r in out} == {"prompt_response", "instruction", "messages", "conversations", "turns"}


def test_json_layouts_meet_their_mappings(spark):
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "be kind"}, "conversations", [("system", "be kind"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "input": "", "output": ""}, "instruction", [("user", "do"), ("assistant", "")]),
        ({"prompt": "p", "response": "r", "meta": {"a": [1, "x"], "b": {}}}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": {"text": "p"}, "completion": {"text": "c"}}, "nested_prompt", [("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
        ({"something": "else"}, None, []),
        ({"messages": [{"role": "user", "text": "other field"}]}, None, []),
    ]
    rows = [(k, json.dumps(r[0])) for k, r in enumerate(records)] + [(90, "{bad"), (91, None), (92, "[1]"), (93, "{}"), (94, '"messages"')]
    df = spark.createDataFrame(rows, "id long, body string")
    got = {r.id: (r.mapping, [(t.role, t.text) for t in r.turns]) for r in chat.turns_of_json(df, "body", ["id"]).collect()}
    assert got == {k: (m, t) for k, (_, m, t) in enumerate(records)} | {k: (None, []) for k in range(90, 95)}


def test_paths_and_fingerprints(spark):
    body = '{"a b":1,"in`put":"","m":{"k":[1,2.5,"s"],"z":{}},"l":[{"p":[{"q":null}]}]}'
    df = spark.createDataFrame([(body,)], "j string").select(chat.paths(F.parse_json("j")).alias("p"))
    assert sorted(df.first().p) == ["a b", "in`put", "l[].p[].q", "m.k[]"]
    same = hashlib.sha256(b"messages[].content\nmessages[].role").hexdigest()
    assert chat.fingerprint_of(("messages[].role", "messages[].content")) == same and same in chat.BY_FINGERPRINT
    assert len(chat.BY_FINGERPRINT) == sum(len(m.fingerprints()) for m in chat.MAPPINGS)
