import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.llm import logistic, truncation as T


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/raw_generations.parquet", columns=["raw_output"]).column(0).to_pylist()
    return sorted({x for x in t if x and x.strip()})


@pytest.fixture(scope="module")
def judge(texts):
    return T.Judge(T.fit([(t, ()) for t in texts[::2]]).astype(np.float32))


def test_held_out_cuts(texts, judge):
    """Cut copies of intact texts the model hasn't seen, against the intact ones."""
    intact = [t for t in texts[1::2] if T._MARK.search(t.rstrip()[-1:]) or t.rstrip().endswith("```")]
    rng = random.Random(4)
    cut = [T._spoil(t[:at], rng) for t in intact for at in T._places(t, rng, 1)]
    assert len(intact) > 100 and len(cut) > 100
    flagged = lambda ts: (judge(ts, [()] * len(ts)) >= T.THRESHOLD).mean()
    assert flagged(cut) > 0.97 and flagged(intact) < 0.01


@pytest.mark.parametrize(
    "text",
    [
        "We know the total is 3. The rest goes to nobody.", "All is said.</reason>", "All is said. (Only this remains.)", "Fine. ✅", "Step 1: it holds.\n\nFinal answer: 87", "It holds.\n\n$$k = \\frac{{1}}{2 + 1}$$", "It holds.\n- the first sum\n- the second sum",
        "It holds.\n\n| the sum | 3 |\n| the rest | 4 |\n==============", "It holds.\n\n```python\nreturn 3\n```", "这里为什么需要余数?最后还剩下7个。", "<reason>That settles the case x < 3.", "It holds.\n\n**Result:** 54 kg",
    ],
)
def test_complete(judge, text):
    assert judge([text], [()])[0] < T.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "The rest goes to nobody. Only the combined prob", "The rest goes to nobody. Only the combined sum in the", "The rest is fine. Only the combined sum in the</reason>", "It holds. The rest goes to the [truncated]", "It holds. The hidden sum of the draft takes…",
        "It holds.\n\n```python\ndef f(x):\n    retu", "It holds. The rest is fine.</rea", "最后还剩下7个。这里为什么需要余", "It holds. Dividing 12 by 30 tells the own<cut>", "It holds. The rest goes to nobody. Only the combin�",
    ],
)
def test_cut_off(judge, text):
    assert judge([text], [()])[0] >= T.THRESHOLD


def test_blank_and_empty(judge):
    assert list(judge([None, "", " \n"], [()] * 3)) == [0, 0, 0]


def test_an_empty_sample_flags_nothing():
    j = T.Judge(T.fit([]).astype(np.float32))
    assert j(["The rest goes to the"], [()])[0] < T.THRESHOLD


def test_logistic_learns_a_rule():
    rng = np.random.default_rng(0)
    rows = [[f"a{rng.integers(50)}", f"b{int(v)}"] for v in rng.integers(0, 2, 2000)]
    y = np.array([r[1] == "b1" for r in rows], float)
    x = logistic.Hashed().matrix(rows)
    assert ((logistic.score(logistic.train(x, y), x) > 0.5) == y).all()


def lengths(df):
    return df.where("text is not null").groupBy(F.col("source").alias("src"), F.lit(False).alias("is_bytes"), F.length("text").alias("length")).agg(F.count("*").alias("n"))


SCHEMA = "rec_id bigint, source string, text string, score double"


def test_operator(spark, texts):
    # a source that cuts at 60 characters, and one that doesn't
    long = [t for t in texts if len(t) > 100 and t.isascii()][:200]
    rows = [(i, "cutter", t[:60], 1.0) for i, t in enumerate(long)] + [(1000 + i, "whole", t, 1.0) for i, t in enumerate(texts[:400])] + [(5000, None, None, None), (5001, "whole", "", None), (5002, "whole", "All is said.", None), (5002, "whole", "All is said.", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    lim = T.length_limits(lengths(df))
    assert {(r.src, r.length) for r in lim.collect()} >= {("cutter", 60)}
    out = T.truncated({"f": df, "g": df.where("false")})
    assert out.count() == len(rows) and out.where("rec_id = 5002").count() == 2
    assert out.where("rec_id in (5000, 5001)").where("truncated or score is not null").count() == 0
    s = {r.source: r for r in T.shares(out).collect()}
    assert s["cutter"].share > 0.3 > 0.2 > s["whole"].share and s[None].share is None and s[None].texts == 0
    assert T.truncated({"f": df.where("false")}).count() == 0


def test_white_space_and_closing_tags_of_any_length_after_a_cut():
    cut = "The trams leave the depot at noon. They meet after twen"
    assert "shape=mid" in T.features(cut) and "shape=mid" in T.features(cut + " " * 2000) and "shape=mid" in T.features(cut + "</reason>\n" * 200)


def test_a_last_line_and_what_follows_a_cut_of_any_length(judge):
    line = "We add the parts of the sum again, one by one. " * 60
    assert judge([line + "Only the combined su", line + "Only the sum remains."], [()] * 2).round().tolist() == [1, 0]
    assert "after=note" in T.features(f"{line}Only the comb [text cut short here {'by the collector ' * 20}]")
    assert "shape=tag" in T.features("It holds. </" + "reason" * 9)


@pytest.mark.parametrize("text", ["(" * 20_000, "[x" * 20_000, "\\frac{" * 10_000, " " * 50_000 + "x", "It holds. " + "* " * 20_000, "<" * 20_000, "</a>" * 20_000])
def test_long_lines_take_no_long_time(text):
    import time

    began = time.time()
    T.features(text)
    assert time.time() - began < 2


def test_every_limit_of_a_source(spark):
    rows = [("s", "x" * n) for n in (7, 100, 300, 500, 700, 900, 1049, 1101) for _ in range(20)]
    got = T.length_limits(lengths(spark.createDataFrame(rows, "source string, text string")))
    assert sorted(r.length for r in got.collect()) == [7, 100, 300, 500, 700, 900, 1049, 1101]


def test_neighbours_are_seen_across_blocks(spark):
    # 1000 is the edge of a block: beside a full neighbourhood on its other side it is no spike
    rows = [("s", n, 100 if n == 1000 else 90) for n in range(950, 1000)] + [("s", 1000, 100), ("t", 1000, 100)]
    df = spark.createDataFrame(rows, "src string, length int, n bigint").withColumn("is_bytes", F.lit(False))
    assert [(r.src, r.length) for r in T.length_limits(df).collect()] == [("t", 1000)]


def test_shares_are_those_of_the_found(spark):
    from mooring.llm import queries as Q

    d = "/root/testdata/sf0.01"
    per = {(r.field, r.source): r.cut for r in Q.p2_source_shares(spark, d).where("cut > 0").collect()}
    src = Q._texts(spark, d)
    found = Q.p2_found(spark, d)
    own = {(f, r.source): r["count"] for f, t in src.items() for r in found.where(F.col("field") == f).join(t, "rec_id").groupBy("source").count().collect()}
    assert per == own and sum(own.values()) > 50


def test_limits_of_many_sources_are_joined(spark, texts):
    """The shuffled way gives what the broadcast one gives."""
    long = [t for t in texts if len(t) > 100 and t.isascii()][:120]
    rows = [(i, None if i % 3 else "cutter", t[:60] if i % 3 == 0 else t) for i, t in enumerate(long)]
    df = spark.createDataFrame(rows, "rec_id bigint, source string, text string")
    a, b = (sorted(map(tuple, T.truncated({"f": df}, shipped=n).collect()), key=repr) for n in (T.LIMITS_SHIPPED, 0))
    assert a == b and len(a) == len(rows)
    lim = spark.createDataFrame([("s", False, 5), ("s", True, 7), ("t", False, 9)], "src string, is_bytes boolean, length int")
    some = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, "u")], "rec_id bigint, src string")
    want = {1: [(False, 5), (True, 7)], 2: [(False, 5), (True, 7)], 3: [(False, 9)], 4: None}
    for shipped in (10, 1):
        assert {r.rec_id: r.limits and [tuple(x) for x in r.limits] for r in T._with_limits(some, lim, shipped).collect()} == want


def test_at_a_limit_in_both_places(spark):
    rows = [("x" * n, [(b, m)]) for n in range(1, 12) for b in (False, True) for m in (4, 7)] + [("é" * n, [(b, 7), (False, 3)]) for n in range(1, 9) for b in (False, True)] + [("x", []), ("x", None)]
    df = spark.createDataFrame(rows, f"t string, l {T._LIMITS}")
    for r in df.select("t", "l", T._at_limit(F.col("t"), F.col("l")).alias("at")).collect():
        assert r["at"] == T.at_limit(r.t, tuple(map(tuple, r.l or ()))), r
