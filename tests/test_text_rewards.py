import pytest
from pyspark.sql import functions as F

from tessellate.functions import rewards as R
from tessellate.functions import text as TX


def _one(spark, col, value, t="string"):
    return spark.createDataFrame([(value,)], f"x {t}").select(col.alias("y")).first().y


def test_task_type_traps(spark):
    for task, exp in [("foo_q&a", "cls"), ("intent_qa", "qa"), ("mime_qna", "qa"), ("x_cls", "cls"),
                      ("foo_qa-", "cls"), (None, "cls"), ("  ", "cls"), ("_Chat_QnA_", "qa"),
                      ("classification", "cls")]:
        assert _one(spark, TX.task_type("x"), task) == exp, task


def test_boxed_empty_and_formats(spark):
    assert _one(spark, TX.boxed_reward("x"), "a \\boxed{} [b]") == ""
    assert _one(spark, TX.boxed_reward("x"), "see [b] and <answer>c</answer>") == "b"
    assert _one(spark, TX.boxed_reward("x"), "plain") == "plain"
    assert _one(spark, TX.boxed_judge("x"), "  \\boxed{}  ") == "\\boxed{}"
    assert _one(spark, TX.answer_phrase("x"), " neutral. well...") == "neutral"


def test_format_ok_matches_fullmatch(spark):
    import re
    pat = re.compile(r"<think>.*</think>.*\\boxed\{.*\}.*", re.DOTALL)
    cases = ["<think>a</think>\\boxed{x}", "<think></think>\\boxed{}", "x<think>a</think>\\boxed{x}",
             "<think>a</think>\n\n\\boxed{x} tail", "<think>a</think>\\boxed{x", "<think>\\boxed{x}</think>",
             "<think></think></think>\\boxed{}}", ""]
    for c in cases:
        exp = 1.0 if pat.fullmatch(c) else 0.0
        assert _one(spark, TX.format_ok("x"), c) == exp, c


def test_overlong_goldens(spark):
    df = spark.createDataFrame([(812,), (748,), (684,), (900,)], "n int")
    got = [r.p for r in df.select(R.overlong_penalty(F.col("n"), 812, 128).alias("p")).collect()]
    assert got == [-1.0, -0.5, 0.0, -1.0]


def test_parse_judge_reply(spark):
    df = spark.createDataFrame([('```json\n{"correct": true, "explanation": "ok"}\n```',), ("Looks TRUE",),
                                ('{"explanation": "x"}',)], "r string")
    rows = df.select(TX.parse_judge_reply("r").alias("v")).collect()
    assert (rows[0].v.correct, rows[0].v.explanation, rows[0].v.status) == (True, "ok", "ok")
    assert rows[1].v.correct is True and rows[1].v.explanation.startswith("Error parsing JSON, content: ")
    assert rows[2].v.status == "missing_field"


def test_reward_v2_cls(spark):
    df = spark.createDataFrame([("<think>r</think>\\boxed{anger}", "anger", "x_cls")], "r string, g string, t string")
    v = df.select(R.reward_v2("r", "g", F.col("t"), max_len=512, buffer=128, factor=1.0).alias("v")).first().v
    assert v.score == pytest.approx(1.0) and v.task_type == "cls"
