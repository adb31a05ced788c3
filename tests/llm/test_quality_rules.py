import random
import re
from collections import Counter

import numpy as np

from quillframe.llm import quality_rules as Q
from tests.llm.conftest import words


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(odd, odd_rows, no_labels, none):
    got = Q.judged(odd, no_labels).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = []
    for r in odd_rows:
        b = brute(r[1])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((r[0], *b, failed, not failed))
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted(want, key=key)
    assert Q.judged(none, no_labels).count() == 0 and Q.accepted(none, no_labels).count() == 0
    kept = Q.accepted(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == sum(x[-1] for x in want)


def test_chunks_don_t_matter():
    texts = [words(k, 1 + k % 50).encode() for k in range(300)]
    at = np.r_[0, np.cumsum([len(x) for x in texts])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    one = np.concatenate([Q.counts(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in texts])
    assert (Q.counts(data, at) == one).all()


def test_learned_rules_hold_out(spark):
    r = random.Random(4)

    def text(i):
        w = words(i, 80).split()
        if i % 3 == 0:
            w = [x + "###" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        return " ".join(w)

    rows = [(i, text(i), 0 if (i % 3 == 0) != (r.random() < 0.01) else 1) for i in range(900)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules and all(rule for rule in rules)
    got = {x.doc_id: x.kept for x in Q.judged(docs, labels, rules=rules).collect()}
    held = [i for i in range(900) if i % 5 == 0]
    assert sum(got[i] != (i % 3 == 0) for i in held) / len(held) > 0.97
    assert all(got[i] for i in held if i % 3)  # clean documents stay


def test_learning_keeps_no_imprecise_rule():
    r = np.random.default_rng(1)
    x, bad = r.random((600, 2)), r.random(600) < 0.3
    assert Q.learn(x, bad, np.arange(600), ["a", "b"]) == []
    assert Q.learn(x, np.zeros(600, bool), np.arange(600), ["a", "b"]) == [] and Q.learn(x[:0], bad[:0], np.arange(0), ["a", "b"]) == []
