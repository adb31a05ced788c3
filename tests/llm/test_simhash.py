import random
import re

import numpy as np
import pytest
import xxhash

from quillframe.llm import simhash as S
from quillframe.llm.components import components


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def labels(values, linked):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_against_brute_force(odd, odd_rows, none):
    fps = [fingerprint(r[1]) for r in odd_rows]
    roots = labels(fps, near)
    ids = {}
    for r, k in zip(odd_rows, roots, strict=True):
        ids[k] = min([x for x in (ids.get(k), r[0]) if x is not None], default=None)
    want = [(r[0], f"{f:016x}", ids[k]) for r, f, k in zip(odd_rows, fps, roots, strict=True)]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in S.classes(odd).collect()), key=key) == sorted(want, key=key)
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))
    assert S.classes(none).count() == 0 and S.deduplicated(none).count() == 0


def test_forest_of_tiles_links_what_brute_force_links():
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 60, dtype=np.uint64)
    some = [c ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False))) for c in centres for _ in range(12)]
    a = np.unique(np.array([0, 1, 2**64 - 1, *some], np.uint64))
    for parts in (1, 10**9):  # both sizes of signature
        S.FINE, keep = parts, S.FINE
        nodes, roots = S.forest(a, a, 3, True)
        S.FINE = keep
        got = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        want = labels(a.tolist(), near)
        assert [got.get(x, x) for x in a.tolist()] == [int(a[k]) for k in want]


def test_many_tiles(spark):
    r = random.Random(9)
    a = sorted({x ^ (1 << r.randrange(64)) for x in [r.getrandbits(64) for _ in range(150)] for _ in range(6)})
    signed = [x - 2**64 if x >= 2**63 else x for x in a]
    got = dict(map(tuple, S.linked(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=20).collect()))
    want = labels(a, near)
    group = {}
    for x, k in zip(signed, want, strict=True):
        group.setdefault(k, []).append(x)
    assert {x: got.get(x, x) for x in signed} == {x: min(g) for g in group.values() for x in g}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_tiles_are_made_by_spark(spark, monkeypatch):
    sizes = {(pc, k): 10 * pc + k for pc in (0, 30, 31, 32, 35, 64) for k in range(20 if pc == 31 else 3)}
    tiles = spark.createDataFrame([(*x, n) for x, n in sizes.items()], "pc int, chunk int, n long")
    got = [(r.pa, r.ca, r.pb, r.cb) for r in S.tile_pairs(tiles, 3).collect()]
    names = sorted(sizes)
    assert sorted(got) == [(*a, *b) for a in names for b in names if a <= b and b[0] - a[0] <= 3]
    assert S.tile_pairs(tiles, 3).filter("na <> 10 * pa + ca or nb <> 10 * pb + cb").count() == 0
    assert S.tile_pairs(tiles, 3).groupBy("square").count().agg({"count": "max"}).first()[0] <= S.HELD**2

    collected, kind = [], type(tiles)
    plain = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(out := plain(self)) or out)
    r = np.random.default_rng(6)
    fps = spark.createDataFrame([(int(x),) for x in r.integers(-(2**63), 2**63, 3000)], "fp long")
    linked = S.linked(fps.distinct(), tile=25)
    assert sum(map(len, collected)) <= 65  # one row for each number of bits; the components' loop reads two sums a round
    linked.count()


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_both_ways_to_keep_rows(spark, odd, monkeypatch, few):
    want = sorted(map(str, S.deduplicated(odd).collect()))
    monkeypatch.setattr(S.C, "FEW", few)
    assert sorted(map(str, S.deduplicated(odd).collect())) == want
