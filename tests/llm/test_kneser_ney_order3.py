import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillframe.llm import kneser_ney as K
from tests.llm.conftest import words
from tests.llm.test_kneser_ney import tokens


class Brute:
    """Order three, word by word."""

    def __init__(self, texts):
        docs = [tokens(t) for t in texts]
        self.one, raw, self.three = Counter(x for d in docs for x in d), Counter(), Counter()
        for d in docs:
            raw.update(zip([0, *d], d, strict=False))
            self.three.update(zip([0, *d], d, d[1:], strict=False))
        self.n, self.v, self.raw = sum(self.one.values()), len(self.one), raw
        after = Counter((v, w) for _, v, w in self.three)
        self.two = {k: c if k[0] == 0 else after[k] for k, c in raw.items()}
        self.cont = Counter(w for _, w in raw)
        self.d = [[0, *K.discounts([sum(c == k for c in x.values()) for k in range(1, 5)])] for x in (self.cont, self.two, self.three)]
        self.rest = sum(self.d[0][min(c, 3)] for c in self.cont.values()) / max(1, len(raw))
        self.sum2, self.left2, self.left3 = Counter(), defaultdict(float), defaultdict(float)
        for (v, _), c in self.two.items():
            self.sum2[v] += c
            self.left2[v] += self.d[1][min(c, 3)]
        for (u, v, _), c in self.three.items():
            self.left3[u, v] += self.d[2][min(c, 3)]

    def p(self, u, v, w):
        c = self.cont[w]
        p = max(c - self.d[0][min(c, 3)], 0) / len(self.raw) + self.rest / (self.v + 1)
        if self.sum2[v]:
            c = self.two.get((v, w), 0)
            p = (c - self.d[1][min(c, 3)] + self.left2[v] * p) / self.sum2[v]
        if u is not None and (u, v) in self.raw:
            c = self.three.get((u, v, w), 0)
            p = (c - self.d[2][min(c, 3)] + self.left3[u, v] * p) / self.raw[u, v]
        return p

    def score(self, t):
        d = tokens(t)
        return sum(math.log10(self.p(u, v, w)) for u, v, w in zip([None, 0, *d], [0, *d], d, strict=False))


def check(docs, texts, train, train_texts):
    model, brute = K.train(train, order=3), Brute(train_texts)
    got = sorted((r.n_tokens, r.score) for r in K.scored(docs, model).collect())
    want = sorted((len(tokens(t)), brute.score(t)) for t in texts)
    assert len(got) == len(want) and [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-9, abs=1e-9)
    return model, brute


def test_against_brute_force(odd, odd_rows):
    check(odd, [r[1] for r in odd_rows], odd.filter("pmod(doc_id, 3) > 0"), [r[1] for r in odd_rows if r[0] is not None and r[0] % 3 > 0])


def test_hot_contexts_and_sums(spark):
    texts = [" ".join(w[:2] for w in words(i, 30 + i % 40).split()) for i in range(120)] + ["zzz " * 500, "a b " * 300, *(f"a b {x}" for x in words(3, 300).split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, brute = check(docs, texts, docs, texts)
    assert model.hot
    for u, v, _ in [*list(brute.three)[:40], (0, "a", 0), ("a", "b", 0)]:
        assert sum(brute.p(u, v, w) for w in [*brute.one, "never seen"]) == pytest.approx(1)
    part = docs.filter("doc_id < 200")
    check(docs, texts, part, texts[:200])


def test_query_uses_two_words_of_context(spark, tmp_path):
    """After ``p q`` comes x, after ``r q`` comes y: one word of context can't tell them apart."""
    rows = [(i, "p q x" if i % 2 else "r q y") for i in range(400)] + [(1000 + i, t) for i, t in enumerate(("p q x", "p q y"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in K.op5_kneser_ney(spark, str(tmp_path)).collect()}
    assert got[1000] - got[1001] > 1


def test_nothing_to_train_on(odd, none):
    assert {(r.train_tokens, r.score) for r in K.scored(odd, K.train(none, order=3)).collect()} == {(0, 0.0)}


def test_narrow_arrays():
    x = np.array([0, 254, 255, 256, 2**40, 3])
    assert K.widened(K.narrow(x), np.array([4, 1, 2, 0, 5, 3])).tolist() == [2**40, 254, 255, 0, 3, 256]
