import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillframe.llm import kneser_ney as K
from tests.llm.conftest import words


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Brute:
    def __init__(self, texts):
        docs = [tokens(t) for t in texts]
        self.one, self.two, self.context = Counter(x for d in docs for x in d), Counter(), Counter()
        for d in docs:
            for v, w in zip([0, *d], d, strict=False):
                self.two[v, w] += 1
                self.context[v] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.cont = Counter(w for _, w in self.two)
        self.high, self.low = ([0, *K.discounts([sum(c == k for c in x.values()) for k in range(1, 5)])] for x in (self.two, self.cont))
        self.rest = sum(self.low[min(c, 3)] for c in self.cont.values()) / max(1, len(self.two))
        self.gamma = defaultdict(float)
        for (v, _), c in self.two.items():
            self.gamma[v] += self.high[min(c, 3)] / self.context[v]

    def p(self, v, w):
        c = self.cont[w]
        low = max(c - self.low[min(c, 3)], 0) / len(self.two) + self.rest / (self.v + 1) if self.two else 1 / (self.v + 1)
        if not self.context[v]:
            return low
        c = self.two.get((v, w), 0)
        return (c - self.high[min(c, 3)]) / self.context[v] + self.gamma[v] * low

    def row(self, t):
        d = tokens(t)
        base = sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in d)
        return len(d), sum(self.one[w] > 0 for w in d), self.n, base, sum(math.log10(self.p(v, w)) for v, w in zip([0, *d], d, strict=False))


def check(docs, rows, train, train_texts):
    model, brute = K.train(train), Brute(train_texts)
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in K.scored(docs, model).collect()), key=lambda x: (x[0], x[3], x[4]))
    want = sorted((brute.row(r[1]) for r in rows), key=lambda x: (x[0], x[3], x[4]))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-9)
    return brute


def test_against_brute_force(odd, odd_rows):
    check(odd, odd_rows, odd.filter("pmod(doc_id, 3) > 0"), [r[1] for r in odd_rows if r[0] is not None and r[0] % 3 > 0])


def test_larger_corpus_with_small_tallies(spark, monkeypatch):
    rows = [(i, " ".join(w[:3] for w in words(i, 30 + i % 40).split())) for i in range(120)] + [(900, "zzz " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    brute = check(docs, rows, docs, [r[1] for r in rows])
    assert sum(brute.p("the", w) for w in [*brute.one, "never seen"]) == pytest.approx(1)
    some = next(iter(brute.context - Counter([0])))
    assert sum(brute.p(some, w) for w in [*brute.one, "never seen"]) == pytest.approx(1)


def test_nothing_to_train_on(odd, odd_rows, none):
    model = K.train(none)
    got = K.scored(odd, model).collect()
    assert len(got) == len(odd_rows) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    assert K.scored(none, model).count() == 0


def test_arrays():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (K.unpack(K.pack(x, True), 1000, True) == x).all() and (K.unpack(K.pack(x), 1000) == x).all()
    t = K.Tally()
    t.add(np.array([3, 1, 3], np.uint64), np.array([1, 2, 4]))
    t.add(np.array([1], np.uint64), np.array([5]))
    assert [y.tolist() for y in t.settle()] == [[1, 3], [7, 5]]
