"""The shape of plans that matters at scale, read off the optimized and physical plans."""

import re

import pytest

from mooring.plans import queries
from mooring.session import spread

Q = queries.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["conversation_qa", "conversation_format", "convert_rows", "long_rows", "validate_rows", "validated", "function_word_skeleton", "controlled_variants", "split_steps", "sampled_steps", "step_boundaries", "parse_reasoning", "prompt_context_choice", "rcot_requests", "r0_requests", "shard_rows"])
def test_row_wise_queries_move_no_rows(spark, small, name):
    p = plan(Q[name](spark, small))
    assert "Exchange" not in p and "Python" not in p and "Arrow" not in p


@pytest.mark.parametrize("name", sorted(set(Q) - {"lexical_anchoring", "scored_records"}))
def test_only_the_alignment_needs_python(spark, small, name):
    assert not re.search("Python|Pandas|InArrow", plan(Q[name](spark, small)))


def test_no_cartesian_product_of_tables(spark, small):
    for name, f in Q.items():
        if name == "scored_records":
            continue
        p = plan(f(spark, small))
        assert "CartesianProduct" not in p, name
        # nested loops only against a single aggregated row
        for side in re.findall(r"BroadcastNestedLoopJoin (Build\w+), (\w+)", p):
            assert side == ("BuildRight", "Cross"), (name, side)


def test_scans_read_only_what_they_need(spark, small):
    p = plan(Q["conversation_format"](spark, small))
    assert "reasoning_trace" not in p
    z = plan(Q["aggregate_by_run"](spark, small))
    assert "scored_at" not in z and "sample_idx" not in z
    assert "PushedFilters: [IsNotNull(sample_idx)" in plan(Q["valid_data"](spark, small).where("sample_idx > 5"))


def test_latest_prunes_before_the_shuffle(spark, small):
    p = plan(Q["latest_raw_output"](spark, small))
    assert p.index("WindowGroupLimit") < p.index("Exchange") and p.count("WindowGroupLimit") == 2


def test_gate_is_an_anti_join(spark, small):
    p = plan(Q["sample_gate"](spark, small))
    assert "LeftAnti" in p and "Window" not in p


def test_spread_moves_only_scans_of_few_splits(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert "Exchange" in plan(spread(df))
    wide = df.repartition(8)
    assert spread(wide) is wide


def test_frequent_words_are_no_hot_keys(spark):
    """Both ways of looking up word shares agree, and the frequent words are never shuffled."""
    from mooring.operators import scoring

    rows = [(i, "A", f"the answer w{i}", "the the step of w%d\n\nthe end w%d" % (i, i + 1)) for i in range(300)]
    long = spark.createDataFrame(rows, "sample_idx bigint, method string, answer string, reasoning string")
    shares = scoring.word_shares(long, "answer", "reasoning")
    tokens = scoring.trace_tokens(long, ["sample_idx", "method"])
    few, many = scoring.with_share(tokens, shares), scoring.with_share(tokens, shares, most=40)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == tokens.count()
    often = shares.where("share >= 1 / 40")
    assert 0 < often.count() <= 40 < shares.count()
    assert "BroadcastHashJoin" in plan(few) and "Exchange hashpartitioning" not in plan(few) and plan(many).count("BroadcastHashJoin") >= 2


def test_the_short_way_of_the_surrogate_gives_what_its_frame_gives(spark, small):
    from mooring.operators import prepare, scoring

    rows = spark.read.parquet(f"{small}/metric_rows.parquet").select("sample_idx", "id", "questions", "answers", "contexts", "reasonings")
    long = scoring.scoreable(prepare.to_long(rows))
    s = scoring.SurrogateScorer()
    a, b = ({(r.sample_idx, r.method): r for r in df.collect()} for df in (s.records(long), scoring.records(s.score(long))))
    assert a.keys() == b.keys() and len(a) > 50
    for k in a:
        assert tuple(a[k][2:]) == pytest.approx(tuple(b[k][2:]), abs=1e-9)
