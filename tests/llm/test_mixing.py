import random
import re
from collections import defaultdict

import pytest

from quillframe.llm import mixing as M


def wanted(sizes, most=3):
    """Targets by source, by the words of the contract."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_odd_rows(odd, odd_rows, none):
    got = M.mixed(odd).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.size) for r in got), key=str) == sorted(((r[0] is None, r[0], size(r[1])) for r in odd_rows), key=str)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[2]] += size(r[1])
    want = wanted(sizes)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
    assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, M.mixed(odd.repartition(5)).collect()))
    assert M.mixed(none).count() == 0 and M.drawn(none).count() == 0


def test_totals_meet_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * (r.randint(1, 200) if i % 50 else 5000), f"s{min(r.randrange(9), 5)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    M.BLOCK, keep = 200, M.BLOCK
    try:
        got = M.mixed(docs).toPandas().merge(docs.select("doc_id", "source").toPandas())
        drawn = M.drawn(docs)
    finally:
        M.BLOCK = keep
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() / by.target).max() < 0.002
    assert drawn.columns == docs.columns and drawn.count() == int((got.taken // got["size"]).sum())


@pytest.mark.parametrize("seed", range(6))
def test_flight_keeps_totals_and_leaves_two(seed):
    r = random.Random(seed)
    n = 200
    size_, count = [float(r.randint(0, 400)) for _ in range(n)], [float(r.randint(1, 2)) for _ in range(n)]
    start = [r.random() if r.random() < 0.9 else float(r.randrange(2)) for _ in range(n)]
    f = M.fly(start, size_, count, seed)
    assert sum(0 < x < 1 for x in f) <= 2 and all(0 <= x <= 1 for x in f)
    for w in (size_, count):
        assert sum(a * b for a, b in zip(f, w, strict=True)) == pytest.approx(sum(a * b for a, b in zip(start, w, strict=True)), rel=1e-6)
    assert all(x in (0.0, 1.0) for x in M.land(f, seed))


def test_landing_follows_the_probabilities():
    f, runs = [0.25, 0.6, 1.0, 0.15, 0.0], 4000
    got = [M.land(f, seed) for seed in range(runs)]
    assert max(abs(sum(x) / runs - p) for x, p in zip(zip(*got, strict=True), f, strict=True)) < 0.03
    assert all(sum(x) == 2 for x in got)  # their number is whole


def test_inclusion_of_decided(spark):
    """Documents of one source of one size class, all with one probability, under many keys: each is taken about as often."""
    r, n, runs = random.Random(4), 60, 40
    sizes = [r.randint(20, 60) for _ in range(n)]
    rows = [(i, "w " * k + f"x{run}", f"{run:02d}{s}") for run in range(runs) for i, k in enumerate(sizes) for s in "ab"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mixed(docs).toPandas()
    got["copies"] = got.taken / got["size"]
    share = got.target / got.source_size
    off = (got.copies - share).groupby(got.doc_id).mean()
    assert off.abs().max() < 0.25 and abs(off.mean()) < 0.02  # 80 draws of each document: three standard errors are 0.17
    by = got.drop_duplicates("target").assign(got=got.groupby("target").taken.sum().reindex(got.drop_duplicates("target").target).to_numpy())
    assert ((by.got - by.target * got.groupby("target").target.nunique().iloc[0]).abs() / by.got).max() < 1


def test_sources_are_numbered_alike_in_one_task_and_in_many(spark, monkeypatch):
    names = [None, "", "a", "B", "é", "\U0001f600", "b"] + [f"s{k}" for k in range(50)]
    df = spark.createDataFrame([(x,) for x in names], "source string")
    one = {r["source"]: r["rank"] for r in M._numbered(df).collect()}
    monkeypatch.setattr(M, "SMALL", 0)
    assert {r["source"]: r["rank"] for r in M._numbered(df).collect()} == one == {x: k + 1 for k, x in enumerate(sorted(names, key=lambda s: (s is None, (s or "").encode())))}


def test_inclusion_follows_the_probabilities():
    n, runs = 30, 600
    size_, start = [float(10 + k) for k in range(n)], [0.2 + 0.02 * k for k in range(n)]
    hits = [0.0] * n
    for seed in range(runs):
        for k, x in enumerate(M.fly(start, size_, [1.0] * n, seed)):
            hits[k] += x
    assert max(abs(h / runs - p) for h, p in zip(hits, start, strict=True)) < 0.09
