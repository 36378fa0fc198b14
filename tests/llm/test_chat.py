import hashlib

import pytest
from pyspark.sql import functions as F

from newsflow.llm import chat
from newsflow.llm.queries import HOSTILE, op1_chat_format

ROWS = [
    (1, 0, "user", "a\\b<|end|>\n<|turn|>x<|content|>"),
    (1, 1, "assistant", "é</s>\\<|\\\\"),
    (1, 1, "assistant", "é</s>\\<|\\\\"),
    (1, 2, "assistant", ""),
    (2, None, None, None),
    (None, 3, "ro\nle<|content|>", "$1 \\1 [INST]"),
    (3, 0, "assistant", "<<|turn|>[[/INST]\U0001f600\\ <<SYS>> <|image|>"),
    (-7, 0, "user", HOSTILE),
    (-7, 1, "assistant", HOSTILE),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def formatted(df):
    return chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))


def test_hostile_texts_are_read_back(spark):
    df = formatted(spark.createDataFrame(ROWS, SCHEMA))
    back = {r.conv_id: tuple(r)[1:] for r in chat.read_back(df).collect()}
    assert len(back) == 5
    for key, got in back.items():
        assert got[:4] == expected([r for r in ROWS if r[0] == key])


def test_loss_spans_cover_the_assistant_alone(spark):
    for row in formatted(spark.createDataFrame(ROWS, SCHEMA)).collect():
        under = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
        own = [r[3] for r in ROWS if r[0] == row.conv_id and r[2] == "assistant"]
        assert len(under) == len(own)
        assert all("<|" not in u and "</s>" not in u and "[INST]" not in u for u in under)
        assert row.formatted_chars == len(row.formatted)


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **k: {
        n: k.get(n) for n in ("text", "ref", "width", "height", "duration_ms", "pages")
    } | {"type": kind}
    parts = [
        part("text", text="see <|image|> "),
        part("image", ref="i1", width=28, height=30),
        part("audio", ref="a1", duration_ms=1001),
        part(None, text="!"),
        part("document", ref="d1", pages=3),
        part("image", ref="i2"),
    ]
    df = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    (row,) = chat.format_chats(df).collect()
    body = "see <\\|image|> <|image|><|audio|>!<|document|><|image|>"
    assert row.formatted.startswith(f"<|turn|>user<|content|>{body}<|end|>\n")
    found = [(a.turn, a.part, a.type, a.ref, a.n_tokens) for a in row.attachments]
    assert found == [
        (0, 1, "image", "i1", 2 * 3),
        (0, 2, "audio", "a1", 51),
        (0, 4, "document", "d1", 3 * chat.PAGE_TOKENS),
        (0, 5, "image", "i2", 1),
    ]
    assert row.n_expanded == sum(f[4] for f in found)
    assert row.n_turns == 3 and [s.length for s in row.loss_spans] == [0, 0]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(formatted(empty)).count() == 0
    clash = spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {"head": F.lit(1), "body": F.lit(2), "turns": F.lit(3), "nth": F.lit(4), "at": F.lit(5)}
    )
    assert chat.read_back(formatted(clash)).count() == 5


def test_escape_is_reversible(spark):
    texts = ["", "\\", "\\\\<|", "<<|", "<\\|", "[\\INST]", "</s></s>", "<<SYS>><</SYS>>", "a\n\\\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e")).select(
        "t", "e", chat.unescape(F.col("e")).alias("u")
    )
    for row in got.collect():
        assert row.u == row.t
        assert not any(c in row.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op1_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("turns", [3000])
def test_a_very_long_conversation(spark, turns):
    rows = [(9, k, "assistant" if k % 2 else "user", f"é{k} " * 20) for k in range(turns)]
    df = formatted(spark.createDataFrame(rows, SCHEMA))
    (got,) = chat.read_back(df).collect()
    assert tuple(got)[1:5] == expected(rows)
