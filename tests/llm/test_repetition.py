import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mooring.llm import repetition as R
from mooring.llm import trees


def brute(s, run=R.RUN):
    seen, cov = set(), [False] * len(s)
    for i in range(len(s) - run + 1):
        g = s[i : i + run]
        if g in seen:
            cov[i : i + run] = [True] * run
        seen.add(g)
    return sum(cov) / len(s) if s else 0.0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=150), st.integers(1, 31))
def test_exact_share_is_the_definition(s, run):
    assert R.exact_share(s, run) == pytest.approx(brute(s, run) if len(s) > run else 0)


def test_letters():
    assert R.letters("Ab-1 é²_中\n") == "abé中" and R.letters(None) == "" and R.letters("Ⅷ½") == "".join(c for c in "Ⅷ½".lower() if c.isalpha())


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/raw_generations.parquet", columns=["raw_output"]).column(0).to_pylist()
    return sorted({x for x in t if x and x.strip()})


def test_trees_with_the_band_leave_no_case_out(texts):
    """Held-out accuracy: what the trees tell alone, and with their band verified."""
    est = R.train(texts[::2])
    other = texts[1::2] + R.loops(texts[1::2], seed=9)
    got = R.estimates(other, est)
    rows = [(brute(R.letters(t)), g, v) for t, (g, v) in zip(other, got) if g is not None]
    assert all((len(R.letters(t)) < R.LEAST_LETTERS) == (g is None) for t, (g, _) in zip(other, got))
    assert all(v is None or v == pytest.approx(share) for share, _, v in rows)
    told = [(share >= R.THRESHOLD, (g if v is None else v) >= R.THRESHOLD) for share, g, v in rows]
    assert sum(a for a, _ in told) > 300 and all(a == b for a, b in told)
    alone = [(share >= R.THRESHOLD) == (g >= R.THRESHOLD) for share, g, _ in rows]
    assert np.mean(alone) > 0.97 and np.mean([abs(share - g) for share, g, _ in rows]) < 0.04
    # the trees decide most texts, on both sides of the band
    assert sum(v is None and g < est.low for _, g, v in rows) > 500 and sum(v is None and g > est.high for _, g, v in rows) > 100
    assert est.error < 0.04 and 0 < est.low < R.THRESHOLD < est.high < 1


def test_without_texts_everything_is_verified():
    est = R.train([])
    loop = "the claim fails so the angle is not enough " * 30
    (_, share), (none, _) = R.estimates([loop, "short"], est)
    assert share == pytest.approx(brute(R.letters(loop))) and none is None


def test_monotone_constraints_hold():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = x[:, 0] - x[:, 1] + rng.normal(0, 0.4, 3000)
    f = trees.fit(x, y, [1, -1, 0])
    grid = np.linspace(0, 1, 60)
    for base in rng.random((40, 3)):
        up, down = np.tile(base, (60, 1)), np.tile(base, (60, 1))
        up[:, 0], down[:, 1] = grid, grid
        assert (np.diff(f.predict(up)) >= -1e-9).all() and (np.diff(f.predict(down)) <= 1e-9).all()
    assert np.corrcoef(f.predict(x), x[:, 0] - x[:, 1])[0, 1] > 0.95


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(2)
    x = rng.random((400, 4))
    f = trees.fit(x, np.sin(5 * x[:, 0]) + x[:, 1], [0, 1, 0, 0], trees=15, depth=3)
    for row, got in zip(x[:50], f.predict(x[:50])):
        want = f.base
        for t in range(len(f.feature)):
            at = 0
            while f.left[t, at] != at:
                at = f.right[t, at] if row[f.feature[t, at]] > f.threshold[t, at] else f.left[t, at]
            want += f.value[t, at]
        assert got == pytest.approx(want)
    assert len(trees.fit(np.zeros((0, 2)), np.zeros(0), [0, 0]).predict(np.zeros((3, 2)))) == 3


SCHEMA = "rec_id bigint, method string, text string, share string"


def test_operator(spark, texts):
    rng = random.Random(0)
    loop = "the claim fails so the angle is not enough " * 30
    rows = [(i, "A", t, None) for i, t in enumerate(rng.sample(texts, 300))] + [(900, "A", loop, None), (900, "A", loop, None), (901, None, "so short", None), (902, "B", None, None), (903, "B", "", None), (904, "B", "abc " * 100_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = R.repeated({"f": df, "g": df.where("false")})
    got = {r.rec_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[901].estimate is None and not got[902].repeated and got[904].repeated
    found = R.found(out).collect()
    want = sorted((i, m) for i, m, t, _ in rows if len(R.letters(t)) >= 60 and brute(R.letters(t) if i != 904 else "abc" * 60) >= R.THRESHOLD)
    assert sorted((r.rec_id, r.method) for r in found) == want and found[0].field == "f"
    assert R.repeated({"f": df.where("false")}).count() == 0 == R.shares({"f": df.where("false")}).count()
    own = R.shares({"f": df}).collect()
    assert len(own) == len(rows) and all((r.share is None) == (len(R.letters(rows[r.rec_id][2])) < 60) and (r.share is None or r.share == pytest.approx(brute(R.letters(rows[r.rec_id][2])))) for r in own if r.rec_id < 900)
