import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mooring.functions import text as X


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("s", ["", " a ", "  x　\n", "\x1c\x1d a \x85", "a\n\nb\n", "​x", None])
def test_strip_is_pythons(spark, s):
    assert one(spark, s, X.strip) == (None if s is None else s.strip())


def test_steps(spark):
    assert one(spark, " a \n\n\n\n b\nc \n\n ", X.steps) == ["a", "b\nc"]
    assert one(spark, None, X.steps) == [] and one(spark, " \n\n ", X.steps) == []


def test_capitalised_lowers_the_rest(spark):
    assert one(spark, "uSER nAME", X.capitalised) == "User name"
    assert one(spark, "", X.capitalised) == ""


GROUP = " ".join(["a"] * 16)


@pytest.mark.parametrize(
    "s,want",
    [
        ("It's the end of an ÉA a café", "It the of an a"), ("xyzzy " * 40, " ".join(["xyzzy"] * 16) + "\n\n" + " ".join(["xyzzy"] * 4)), ("?!" * 150, "?!" * 100), ("a " * 40, "\n\n".join([GROUP, GROUP, " ".join(["a"] * 8)])),
        ("a " * 200, "\n\n".join([GROUP] * 8)), ("", ""), ("Ünïcode Straße über", "Ünïcode Straße über"), ("THE_end the-end Then", "the Then"),
    ],
)
def test_function_word_skeleton(spark, s, want):
    assert one(spark, s, X.function_word_skeleton) == want


def test_function_word_skeleton_golden(spark):
    assert one(spark, "It's the end of an ÉA a café", X.function_word_skeleton) == "It the of an a"
    assert one(spark, None, X.function_word_skeleton) == ""


@pytest.mark.parametrize(
    "raw,reason,skeleton,mode",
    [
        ("x <REASON> a </reason> y <reason>b</reason>", "a", "", "tagged"),
        ("<skeleton>s</skeleton><reason>a", "a", "s", "open_reason_tag"),
        ("<reason></reason>", "</reason>", "", "open_reason_tag"),
        ("<skeleton>s</skeleton> a", "<skeleton>s</skeleton> a", "s", "raw"),
        ("  ", "", "", "raw"),
        (None, "", "", "raw"),
        ("<reason>a\nb</reason>", "a\nb", "", "tagged"),
    ],
)
def test_parse_reasoning(spark, raw, reason, skeleton, mode):
    r = one(spark, raw, X.parse_reasoning)
    assert (r.reason, r.skeleton, r.mode) == (reason, skeleton, mode)


MSG = "array<struct<role:string,from_role:string,content:string,value:string>>"


def msg(role, content):
    return (role, None, content, None)


@pytest.mark.parametrize(
    "messages,q,a",
    [
        ([msg("user", "A"), msg("assistant", "B"), msg("user", "C")], "C", "B"),
        ([(None, "human", None, "A"), (None, "gpt", None, "B")], "A", "B"),
        ([msg("user", "A"), msg("user", ""), msg("assistant", "B")], "User: A\nUser: \nAssistant: B", "B"),
        ([msg("assistant", "B")], "Assistant: B", "B"),
        ([msg("system", "S"), msg("USER", "A")], "A", ""),
        ([], "", ""),
        (None, "", ""),
        ([None, msg("user", "A")], "A", ""),
        ([msg("", "x"), msg(None, "y")], "User: x\nUser: y", ""),
    ],
)
def test_question_answer(spark, messages, q, a):
    r = one(spark, messages, X.question_answer, MSG)
    assert (r.question, r.answer) == (q, a)


def test_format_conversation_null_message_is_an_empty_line(spark):
    assert one(spark, [msg("uSER", "a"), None, msg("x y", "b")], X.format_conversation, MSG) == "User: a\n\nX y: b"


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="<>/reasonRk \nx", max_size=60))
def test_parse_reasoning_is_total(spark, s):
    r = one(spark, s, X.parse_reasoning)
    assert r.mode in ("tagged", "open_reason_tag", "raw") and r.reason == r.reason.strip()
