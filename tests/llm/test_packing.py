import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mooring.llm import packing as P


def online(sizes, capacity, limit):
    """Bounded best fit, spelled out."""
    open_, out, made = [], [], 0
    for s in sizes:
        fit = [b for b in open_ if b[1] >= s]
        if fit:
            b = min(fit, key=lambda b: b[1])
        else:
            if len(open_) >= limit:
                open_.remove(min(open_, key=lambda b: b[1]))
            b = [made, capacity]
            made += 1
            open_.append(b)
        b[1] -= s
        out.append(b[0])
        if not b[1]:
            open_.remove(b)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_bins_do_bounded_best_fit(sizes, limit):
    b = P.Bins(20, limit)
    at = {}
    for i, s in enumerate(sizes):
        for one, items in b.add(i, s):
            at.update(dict.fromkeys(items, one))
        assert len(b.held) <= limit
    for one, items in b.finish():
        at.update(dict.fromkeys(items, one))
    free = defaultdict(lambda: 20)
    for i, s in enumerate(sizes):
        free[at[i]] -= s
    assert len(at) == len(sizes) and all(f >= 0 for f in free.values())
    assert len(free) == len(set(online(sizes, 20, limit)))


def test_zero_sizes_and_bad_arguments():
    b = P.Bins(5, 2)
    got = b.add("a", 0) + b.add("b", 5) + b.add("c", 0)
    assert ("c" in [x for _, items in got for x in items]) and sum(len(i) for _, i in got + b.finish()) == 3
    with pytest.raises(ValueError):
        P.Bins(0)
    only = P.Bins(5, 2)
    assert [x for i in range(3) for x in only.add(i, 0)] == [(0, [0]), (0, [1]), (0, [2])] and only.finish() == []


def test_zero_sizes_never_travel(spark):
    """Each is final in the task it is read in, wherever no bin was full before."""
    rows = [(1, i, 0 if i % 2 else 10, 100) for i in range(40)]
    out = list(P._level(((*r[:2], 0, *r[2:]) for r in rows), 64, 0, 0, False))
    assert len(out) == 40 and all(final for *_, size, _, _, final in out if size == 0) and sum(not final for *_, final in out) == 9


def sizes(spark, values, parts=7):
    return spark.createDataFrame(values, "spec_id int, doc_id bigint, size int, capacity int").repartition(parts, "doc_id")


def check(spark, values, packed):
    rows = packed.collect()
    want = {(s, d): (n or 0) for s, d, n, _ in values}
    cap = {s: c for s, _, _, c in values}
    pieces, used = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r.spec_id, r.doc_id].append(r)
        used[r.spec_id, r.container] += r.size
        assert r.first == r.piece * cap[r.spec_id] and r.container
    assert set(pieces) == set(want)
    for k, ps in pieces.items():
        ps.sort(key=lambda r: r.piece)
        n, c = want[k], cap[k[0]]
        assert [p.size for p in ps] == [min(c, n - i * c) for i in range(max(1, -(-n // c)))]
    assert all(u <= cap[s] for (s, _), u in used.items())
    return used


def test_every_item_once_and_well_filled(spark):
    rng = random.Random(2)
    values = [(s, i, rng.choice([0, 1, rng.randrange(1, 60), rng.randrange(1, 300), None]) if i % 97 else 777, c) for s, c in ((1, 200), (2, 64)) for i in range(3000)]
    used = check(spark, values, P.pack(sizes(spark, values, 12), "doc_id", "bigint", open_bins=16))
    for s, c in ((1, 200), (2, 64)):
        total, bins = sum(u for (k, _), u in used.items() if k == s), sum(k == s for k, _ in used)
        assert total / (bins * c) > 0.97


def test_many_levels(spark):
    values = [(1, i, 30 + i % 40, 100) for i in range(900)]
    used = check(spark, values, P.pack(sizes(spark, values, 40), "doc_id", "bigint", open_bins=2, fan_in=3))
    assert len(used) < 1.3 * sum(v[2] for v in values) / 100 + 2


def test_small_inputs(spark):
    assert P.pack(sizes(spark, []), "doc_id", "bigint").count() == 0
    check(spark, [(1, 1, 250, 100)], P.pack(sizes(spark, [(1, 1, 250, 100)]), "doc_id", "bigint"))
    check(spark, [(1, 1, 0, 100), (1, 2, None, 100)], P.pack(sizes(spark, [(1, 1, 0, 100), (1, 2, None, 100)]), "doc_id", "bigint"))


def test_corpus(spark, small):
    from mooring.llm import queries

    packed = queries.p7_containers(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert packed.groupBy("spec_id").agg(F.countDistinct("doc_id").alias("n")).where(f"n != {docs}").count() == 0
    specs = spark.read.parquet(f"{small}/pack_specs.parquet")
    f = P.fill(packed, specs).collect()
    assert len(f) == 3 and all(r.sound and r.containers <= r.least_containers * 1.1 + 1 for r in f)
    told = queries.p7_fill(spark, small).collect()
    assert len(told) == 3 and all(r["items"] == docs and r.pieces_whole and r.unsplit and r.within for r in told)
    # broken packings are told
    half = P.invariants(packed.withColumn("size", F.col("size") * 2), specs).collect()
    assert not any(r.within for r in half)
    assert not any(r.pieces_whole for r in P.invariants(packed.withColumn("piece", F.col("piece") + 1), specs).collect())
