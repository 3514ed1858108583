import pytest
from pyspark.sql import functions as F

from mooring.operators import generation as G
from mooring.operators import prepare, scoring, summary
from mooring.schemas import CONTROL_METHODS, SECTIONS

NAN, INF = float("nan"), float("inf")
ROW = "sample_idx bigint, id string, " + ", ".join(f"{s} map<string,string>" for s in SECTIONS)


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def same(m, text):
    return {k: text for k in m}


def test_long_and_wide(spark):
    r = rows(spark, (1, "a", {"SSR": "q", "NEU": "q2"}, {"SSR": "x"}, None, {"SSR": "r", "NEU": None}), (2, "b", {}, {}, {}, {}), (3, "c", None, None, None, None))
    long = prepare.to_long(r)
    got = [tuple(x) for x in long.orderBy("method_pos").collect()]
    assert got == [(1, "a", 0, "SSR", "q", "x", None, "r"), (1, "a", 1, "NEU", "q2", None, None, None)]
    w = prepare.to_wide(long).first()
    assert list(w.questions) == ["SSR", "NEU"] and w.answers == {"SSR": "x", "NEU": ""} and w.contexts == {"SSR": "", "NEU": ""}
    assert prepare.to_wide(long.unionByName(long)).first().questions == {"SSR": "q", "NEU": "q2"}


def test_validation(spark):
    ok = ({"A": "q"}, {"A": "a"}, {"A": "c"}, {"A": "r"})
    r = rows(spark, (1, "x", *ok), (2, "y", *ok[:3], None), (3, "z", {"A": "  "}, *ok[1:]), (4, None, {"B": "q"}, *ok[1:]))
    why = {x.sample_idx: x.why for x in r.select("sample_idx", prepare.first_failure(["A"]).alias("why")).collect()}
    assert why == {1: None, 2: "missing dict section: reasonings", 3: "section questions missing methods: A", 4: "section questions missing methods: A"}
    assert [x.sample_idx for x in prepare.validate(r, ["A"]).collect()] == [1]
    assert tuple(prepare.validation_counts(r, ["A"]).first()) == (4, 1, 3)
    assert tuple(prepare.validation_counts(r.where("false"), ["A"]).first()) == (0, 0, 0)
    with pytest.raises(Exception, match="invalid"):
        prepare.validate(r, ["A"], strict=True).collect()


def test_convert(spark):
    m = lambda *x: [(r, None, c, None) for r, c in x]
    t = spark.createDataFrame(
        [(0, None, "why", m(("user", "Q"), ("assistant", "A"))), (1, "i", " ", m(("user", "Q"), ("assistant", "A"))), (2, "j", "why", m(("user", "Q"))), (3, "k", None, None)],
        "row_idx bigint, id string, reasoning_trace string, conversations array<struct<role:string,from_role:string,content:string,value:string>>",
    )
    got = prepare.convert(t, "SSR").collect()
    assert len(got) == 1 and got[0].id == "0" and got[0].contexts == {"SSR": "User: Q\nAssistant: A"} and got[0].reasonings == {"SSR": "why"}


def test_controlled(spark):
    r = rows(spark, (1, "a", {"SSR": "q"}, {"SSR": "the a"}, {"SSR": ""}, {"SSR": "r"}), (2, "b", {"SSR": "q"}, {"SSR": " "}, {}, {"SSR": "r"}))
    got = prepare.controlled(r, "SSR").orderBy("method_pos").collect()
    assert [(x.method, x.reasoning, x.context) for x in got] == list(zip(CONTROL_METHODS, ["r", "r\n\nthe a", "the a", "the a"], ["q"] * 4))


RAW = "seq bigint, row_idx int, id string, method string, raw_output string"


def test_latest_wins_and_null_method_is_r0(spark):
    raw = spark.createDataFrame([(0, 0, "a", "NEU", "x"), (1, 0, "a", "NEU", "y"), (2, 0, "a", None, "z"), (3, 0, "a", "R0", None)], RAW)
    got = {(x.row_idx, x.method): x.raw_output for x in G.latest(raw).collect()}
    assert got == {(0, "NEU"): "y", (0, "R0"): None}
    assert G.latest(raw.where("false")).count() == 0


def indexed(spark):
    two = {"NEU": "q", "SSR": "q2"}
    r = rows(spark, (0, "a", two, same(two, "a"), {}, {}), (1, None, {"SSR": "s"}, {}, {"SSR": "ctx "}, {}), (2, "c", {}, {}, None, {}))
    return r.withColumn("row_idx", F.col("sample_idx").cast("int"))


def test_requests(spark):
    r = indexed(spark)
    got = {(x.row_idx, x.method): x.prompt_context for x in G.rcot_requests(r, ["NEU", "SSR"]).collect()}
    assert got == {(0, "NEU"): "User: q\n\nAssistant: a", (0, "SSR"): "User: q2\n\nAssistant: a", (1, "SSR"): "ctx "}
    blind = {x.row_idx: (x.source_method, x.prompt_context, x.sample_id) for x in G.r0_requests(r).collect()}
    assert blind == {0: ("NEU", "q", "a"), 1: ("SSR", "s", "1")}
    assert G.r0_requests(r, limit=1).count() == 1
    with pytest.raises(ValueError):
        G.rcot_requests(r, ["NOPE"])
    assert G.split_methods(" a,, b ") == ["a", "b"]


def test_pending_generate_and_resume(spark):
    req = G.rcot_requests(indexed(spark), ["NEU", "SSR"])
    raw = spark.createDataFrame([(0, 0, "a", "NEU", "x")], RAW)
    todo = G.pending(req, raw)
    assert {(x.row_idx, x.method) for x in todo.collect()} == {(0, "SSR"), (1, "SSR")}
    made = G.generate(todo, G.echo_generator, chunk=1).collect()
    assert len(made) == 2 and all(x.raw_output.startswith("<reason>") and x.prompt_chars > x.prompt_context_chars for x in made)


def test_builds(spark):
    raw = spark.createDataFrame([(0, 0, "a", "NEU", "<skeleton>k</skeleton><reason>n</reason>"), (1, 0, "a", "SSR", "s"), (2, 1, None, "SSR", "  "), (3, 0, "a", None, "<reason>b"), (4, 2, "c", "R0", "")], RAW)
    r = indexed(spark)
    got = G.rcot_build(r, raw, ["NEU", "SSR"]).collect()
    assert len(got) == 1 and got[0].reasonings == {"NEU": "n", "SSR": "s"} and got[0].generated_skeletons == {"NEU": "k"} and got[0].generated_parse_modes == {"NEU": "tagged", "SSR": "raw"}
    assert {x.row_idx: (x.id, x.missing) for x in G.rcot_rejected(r, raw, ["NEU", "SSR"]).collect()} == {1: ("1", ["NEU", "SSR"]), 2: ("c", ["NEU", "SSR"])}
    assert {x.mode: x.n for x in G.parse_counts(G.rcot_parts(r, raw, ["NEU", "SSR"])).collect()} == {"tagged": 1, "raw": 2}
    b = G.r0_build(r, raw).collect()
    assert len(b) == 1 and b[0].questions == {"R0": "q"} and b[0].contexts == {"R0": "q"} and b[0].reasonings == {"R0": "b"}
    assert {x.row_idx: x.reason for x in G.r0_rejected(r, raw).collect()} == {1: "missing_raw_output", 2: "empty_reasoning"}


RECORD = "method string, sample_idx bigint, lexical_anchoring double, entropy_anchoring double, aprob double"


def test_gate_is_all_or_nothing(spark):
    r = spark.createDataFrame([("A", 1, 0.1, 0.1, 0.1), ("B", 1, 0.1, NAN, 0.1), ("A", 2, 0.1, 0.1, 0.1), ("B", 2, 0.1, 0.1, 0.1), ("A", 3, None, 0.1, 0.1)], RECORD)
    v = ("lexical_anchoring", "entropy_anchoring", "aprob")
    assert {x.sample_idx for x in scoring.gate(r, ["sample_idx"], v).collect()} == {2}
    assert scoring.gate(r.where("false"), ["sample_idx"], v).count() == 0


def test_zones_golden(spark):
    r = spark.createDataFrame([("NEU", 1, 0.2, 0.1, 0.04), ("NEU", 2, 0.8, 0.6, 0.49), ("SSR", 3, 0.1, 0.3, 0.09), ("SSR", 4, 0.4, 0.9, 1.21), ("SSR", 5, 0.3, 0.5, -0.2)], RECORD)
    t = summary.thresholds(summary.scale(r)).first()
    assert (t.x_threshold, t.y_threshold) == (pytest.approx(0.54), pytest.approx(0.46))
    z = {x.method: x for x in summary.zones(r).collect()}
    assert (z["NEU"].N, z["NEU"].Alex, z["NEU"].Aent, z["NEU"].Aprob) == (2, pytest.approx(50), pytest.approx(35), pytest.approx(45))
    assert (z["NEU"].Reason, z["NEU"].Encode, z["NEU"].Cloze, z["NEU"].Copy) == (50, 0, 0, 50)
    assert (z["SSR"].Alex, z["SSR"].Aent, z["SSR"].Aprob) == (pytest.approx(26.6667, abs=1e-3), pytest.approx(56.6667, abs=1e-3), pytest.approx(43.3333, abs=1e-3))
    assert z["SSR"].Reason + z["SSR"].Encode + z["SSR"].Cloze + z["SSR"].Copy == pytest.approx(100)


def test_zones_with_nan_and_null(spark):
    r = spark.createDataFrame([("A", 1, 0.2, NAN, 0.5), ("A", 2, 0.2, 0.5, 0.5), (None, 3, 0.1, 0.1, 0.1), ("A", 4, 0.1, 0.9, None)], RECORD)
    z = summary.zones(r).collect()
    assert [x.method for x in z] == ["A"] and z[0].N == 3 and z[0].Reason + z[0].Encode + z[0].Cloze + z[0].Copy < 100
    with pytest.raises(Exception, match="quantile"):
        summary.thresholds(r.where("false")).collect()


def test_aggregate(spark):
    r = spark.createDataFrame([("A", 1, 0.2, 0.1, 0.7), ("A", 2, 0.4, 0.9, 0.1), ("A", 3, 0.4, INF, 0.1), ("B", 4, NAN, 0.1, 0.1), (None, 5, None, 0.1, 0.1), ("C", 6, 0.1, 0.2, None), ("D", 7, 0.1, None, 0.3)], RECORD)
    g = {x.group: x for x in summary.aggregate(r).collect()}
    assert set(g) == {"A", "unknown", "D"}  # B has skipped records only, C no aprob
    a = g["A"]
    assert (a.N, a.skipped_nan, a.mean_lexical_anchoring, a.Encode, a.Cloze) == (2, 1, pytest.approx(0.3), 0.5, 0.5)
    assert g["unknown"].mean_lexical_anchoring is None and g["D"].Reason is None
    assert summary.aggregate(r.where("false")).count() == 0


def test_method_order(spark):
    assert summary.method_order(["SSR", "NEU"]) == ["NEU", "SSR"]
    assert summary.method_order(["Response as CoT", "Real CoT"]) == ["Real CoT", "Response as CoT"]
    assert summary.method_order(["z", "Real CoT", "a", "SSR"]) == ["SSR", "Real CoT", "a", "z"]
    r = spark.createDataFrame([("z",), ("SSR",), (None,), ("SSR",), ("Real CoT",)], "method string")
    assert [x.method for x in summary.ordered_methods(r).orderBy("position").collect()] == ["SSR", "Real CoT", "z"]
    assert tuple(summary.covers(r, ["SSR", "q"]).first()) == (False, ["q"])
    assert tuple(summary.covers(r, ["SSR"]).first()) == (True, [])


def test_controlled_variants_move_their_metric(spark, small):
    from mooring.plans import queries as Q

    long = prepare.controlled(Q._rows(spark, small), "SSR")
    rec = scoring.records(scoring.SurrogateScorer().score(scoring.scoreable(long)))
    m = {x.method: x for x in rec.groupBy("method").agg(F.avg("lexical_anchoring").alias("l"), F.avg("Aprob").alias("p")).collect()}
    assert m["Response as CoT"].l == pytest.approx(1)
    assert m["+Prob Anchor"].p > m["Real CoT"].p


def test_scorer_errors_become_rows(spark):
    def make():
        def score(q, a, c, r):
            if a == "bad":
                raise ValueError("no")
            return {"reason_tokens": r.split(), "ans_tokens": a.split(), "end_pos": [1, 2, 3], "log10p_base": -4.0, "log10p_final": -1.0, "entropies": [1.0, 2.0, 3.0]}

        return score

    long = spark.createDataFrame([(1, "A", "q", "a b", None, "a x b"), (2, "A", "q", "bad", "c", "r")], "sample_idx bigint, method string, question string, answer string, context string, reasoning string")
    s = scoring.ModelScorer(make).score(long)
    assert {x.sample_idx: x.error for x in s.collect()} == {1: None, 2: "ValueError: no"}
    r = {x.sample_idx: x for x in scoring.records(s).collect()}
    assert r[1].lexical_anchoring == 1 and r[1].Aprob == pytest.approx(0.75) and r[2].Aprob is None
