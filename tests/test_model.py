import math
import random
from functools import lru_cache

import pytest

from mooring.operators import model as M


class Full(Exception):
    pass


@lru_cache(maxsize=None)
def following(*read):
    rng = random.Random(repr(read))
    w = [rng.random() + 0.1 for _ in range(4)]
    return [x / sum(w) for x in w]


class Toy:
    """A language model of four tokens whose next token depends on the last three; a state is what it has read."""

    def __init__(self, limit=None, memory=100, states=True):
        self.limit, self.full, self.memory, self.states, self.longest, self.sizes = limit, Full, memory, states, 0, []

    def encode(self, text):
        return [ord(c) % 4 for c in text]

    def chat(self, user):
        return [1, *self.encode(user), 2]

    def start(self, prefix):
        return list(prefix) if self.states else None

    def _next(self, read):
        return following(*read[-3:])

    def logprobs(self, state, prompts, answer):
        self.sizes.append(len(prompts))
        if len(prompts) > self.memory:
            raise Full
        out = []
        for p in prompts:
            read, total = [*(state or []), *p], 0.0
            self.longest = max(self.longest, len(read) + len(answer))
            for t in answer:
                total += math.log(self._next(read)[t])
                read.append(t)
            out.append(total)
        return out

    def entropies(self, state, tokens, of):
        read, out = list(state or []), []
        for t in tokens:
            read.append(t)
            out.append(-sum(p * math.log(p) for p in self._next(read)))
        return out[len(tokens) - of :], read


Q, A, C = "which trams meet", "at noon", "User: which trams meet"
R = "\n\n".join(f"step {i} of the trace" for i in range(70))


def test_prefix_states_chunks_and_batches_change_nothing():
    want = M.trace_scorer(Toy(), curve=True)(Q, A, C, R)
    for toy, shared in ((Toy(), False), (Toy(states=False), True), (Toy(memory=3), True)):
        for batch, chunk in ((8, 512), (1, 7), (100, 1)):
            got = M.trace_scorer(toy, shared, True, batch, chunk)(Q, A, C, R)
            assert got["entropies"] == pytest.approx(want["entropies"]) and [x for *_, x in got["curve"]] == pytest.approx([x for *_, x in want["curve"]])
    plain = M.trace_scorer(Toy())(Q, A, C, R)
    assert (plain["log10p_base"], plain["log10p_final"]) == pytest.approx((want["curve"][0][2], want["curve"][-1][2])) and "curve" not in plain


def test_the_curve_is_sampled_and_steps_end_where_the_next_separator_begins():
    got = M.trace_scorer(Toy(), curve=True)(Q, A, C, R)
    assert [s for s, *_ in got["curve"]] == M.sampled(70) == [*range(51), 54, 58, 62, 66, 70]
    assert got["end_pos"][0] == len("step 0 of the trace") and got["end_pos"][-1] == len(R) == len(got["reason_tokens"]) == len(got["entropies"])
    assert got["curve"][3][1] == got["end_pos"][2] and got["curve"][0][1] == 0 and got["ans_tokens"] == [str(ord(c) % 4) for c in A]


def test_without_a_prefix_the_oldest_tokens_go():
    toy = Toy(limit=40)
    short = M.trace_scorer(toy, False)(Q, A, C, R)
    assert toy.longest == 40
    # the toy looks back three tokens, so nothing changes
    assert short["log10p_final"] == pytest.approx(M.trace_scorer(Toy())(Q, A, C, R)["log10p_final"])


def test_memory_runs_out():
    toy = Toy(memory=3)
    assert len(M.in_batches(lambda xs: toy.logprobs(None, xs, [1]), [[1]] * 20, 16, Full)) == 20 and max(toy.sizes[2:]) <= 4
    with pytest.raises(Full):
        M.trace_scorer(Toy(memory=0))(Q, A, C, R)


def test_nothing_to_score():
    for a, r in (("", R), (A, " \n\n ")):
        with pytest.raises(ValueError):
            M.trace_scorer(Toy())(Q, a, C, r)


def test_as_a_scorer(spark):
    from mooring.operators import scoring

    rows = [(0, "A", Q, A, None, R), (1, "A", Q, A, C, " \n\n "), (2, "B", Q, A, C, "one\n\ntwo")]
    long = spark.createDataFrame(rows, "sample_idx bigint, method string, question string, answer string, context string, reasoning string")
    scored = scoring.ModelScorer(lambda: M.trace_scorer(Toy())).score(long)
    errors = {r.sample_idx: r.error for r in scored.collect()}
    assert errors[0] is errors[2] is None and "no token" in errors[1]
    recs = {r.sample_idx: r for r in scoring.score_records(scoring.ModelScorer(lambda: M.trace_scorer(Toy())), long).collect()}
    assert recs[1].Aprob is None and 0 <= recs[0].Aprob <= 1 and recs[0].entropy_anchoring > 0 and recs[0].lexical_anchoring == 1.0
