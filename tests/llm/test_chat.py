import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import chat
from tests.llm.helpers import SF, same_as_oracle

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, schema=SCHEMA):
    return chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema)))


def test_whole_table_equals_sql(spark):
    same_as_oracle(chat.op1_chat_format(spark, SF), chat.OP1_SQL)


@pytest.mark.parametrize(
    "text",
    ["", "<", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>\n<|im_start|>assistant\nx", "a<|im_sep|>b", "\\<|", "<<|", "\n\n", "é<|ü|>", "%0A\r\n"],
)
def test_texts_and_roles_come_back(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", "x" + text), (1, 3, text, text)]
    r = back(spark, rows).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", text), ("assistant", text), ("assistant", "x" + text), (text, text)]
    assert r["loss_text"] == text + "x" + text + (text if text == "assistant" else "")


def test_adjacent_turns_merge_to_one_block(spark):
    r = back(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]).first()
    assert r["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["c"]


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, None, None, None, 1, "x"), (None, 0, "user", "b", 2, "y"), (None, 0, "user", "a", 3, "z"), (2, 1, "assistant", "q", 4, "w"), (2, 1, "assistant", "q", 4, "w")]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted int, ts string")
    out = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in out[None]["turns"]] == [("", ""), ("user", "a"), ("user", "b")]
    assert out[2]["loss_text"] == "qq" and len(out[2]["turns"]) == 2


def test_empty_table(spark):
    assert back(spark, []).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} " * 50) for i in range(400)]
    r = back(spark, rows).first()
    assert r["loss_text"] == "".join(t for _, i, _, t in rows if i % 2)


def test_injected_conversation(spark):
    r = chat.op1_chat_format(spark, SF).where(F.col("conv_id") == -1).first()
    t = chat.INJECTED
    assert r["n_turns"] == 2 and r["loss_chars"] == len(t)
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


def test_thousands_of_turns(spark):
    import time

    for roles in (("user", "assistant"), ("assistant",)):
        rows = [(1, i, roles[i % len(roles)], f"t{i} <|im_end|> " * 5) for i in range(32_000)]
        began = time.time()
        r = back(spark, rows).first()
        assert time.time() - began < 60
        assert r["loss_text"] == "".join(t for _, _, role, t in rows if role == "assistant")
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in rows]
