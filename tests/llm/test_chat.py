import hashlib

from pyspark.sql import functions as F

from stateroll.llm import chat
from stateroll.llm.queries import QUERIES, SQL
from tests.llm import oracle

ROWS = [
    (1, 1, "user", "hi </turn> <turn assistant>"), (1, 2, "assistant", "100%3C <b> %25 é🙂"), (1, 3, "assistant", None), (1, 4, "user", "bye"), (1, 5, "assistant", "ok"),
    (2, 2, None, "x"), (2, 2, None, "x"), (2, None, "a<b>%3E%", ""), (3, 1, "user", None), (None, 1, "assistant", "alone"), (4, 1, "assistant", "long " * 200_000),
]


def order(r):
    return tuple((x is not None, x) for x in r[1:])


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")


def test_turns_come_back(spark):
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_conversations(frame(spark)).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == c), key=order)] for c in {r[0] for r in ROWS}}


def test_examples(spark):
    ex = chat.examples(chat.format_conversations(frame(spark)).withColumn("whole", F.col("formatted")))
    rows = ex.select("conv_id", "example", "context", "reply", chat.target(F.col("whole"), F.col("start"), F.col("chars")).alias("target"), "whole").orderBy("example").collect()
    one = [r for r in rows if r.conv_id == 1]
    assert [r.reply for r in one] == ["100%3C <b> %25 é🙂", "", "ok"]
    for r in one:
        assert r.whole.startswith(r.context + r.target)
        assert r.context.endswith("<turn assistant>")
    assert one[2].context.count("</turn>") == 4
    assert {r.conv_id for r in rows} == {1, None, 4}


def test_many_turns_in_one_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}<") for k in range(3000)]
    ex = chat.examples(chat.format_conversations(frame(spark, rows)))
    got = ex.orderBy("example").collect()
    assert [r.reply for r in got] == [f"t{k}<" for k in range(1, 3000, 2)]
    assert len(got[-1].context) == got[-1].start and got[-1].context.endswith("<turn assistant>")


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "a")], "`c.id` int, `t.n` int, `the.role` string, `the.text` string")
    got = chat.examples(chat.format_conversations(df, "c.id", "t.n", "the.role", "the.text")).collect()
    assert [(r["c.id"], r.reply) for r in got] == [(1, "a")]


def test_empty(spark):
    assert chat.format_conversations(frame(spark, [])).count() == 0


def test_query(spark):
    assert oracle.frame(QUERIES["op10_chat"](spark, oracle.SF)) == oracle.rows(SQL["op10_chat"])
    r = QUERIES["op10_chat"](spark, oracle.SF).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op10_chat"](spark, oracle.SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
