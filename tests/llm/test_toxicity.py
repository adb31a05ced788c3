import random
import zlib

import numpy as np
import pytest

from quillframe.llm import toxicity as X
from quillframe.llm.token_counts import Table
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def corpus(spark):
    r, rows = random.Random(8), []
    for i in range(1500):
        s = [words(i * 97 + k, 8) for k in range(r.randint(1, 12))]
        if i % 6 == 0:
            k = r.randrange(len(s))
            s[k] += r.choice([" grumbolt", " Vexling", f" snarkel{words(i, 1)}"])
        rows.append((i, ". ".join(s) + ".", int(i % 6 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").cache()
    return docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"), rows


def test_held_out_accuracy_and_sentences(corpus):
    docs, labels, rows = corpus
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.scored(docs, model).collect()}
    held = [x for x in rows if got[x[0]].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(got[i].predicted == t for i, _, t in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    bad = {r.doc_id: r for r in X.sentences(docs, model).collect()}
    hits = [i for i, _, t in held if t and i in bad]
    text = {i: t for i, t, _ in rows}
    assert len(hits) > 20
    for i in hits:
        s = bad[i]
        assert text[i][s.start : s.end] == s.sentence and any(w in s.sentence.lower() for w in ("grumbolt", "vexling", "snarkel"))
        assert text[i][got[i].worst_start : got[i].worst_end] == s.sentence


def test_score_is_the_noisy_or(odd, odd_rows, corpus):
    model = X.fit(*corpus[:2])
    for text in ("grumbolt. fine words here. Vexling! ok", "nothing", "", "..."):
        data = np.frombuffer(text.encode(), np.uint8)
        bag = X.bags(data, np.array([0, len(data)]))
        p = 1 / (1 + np.exp(-X.activations(bag, model, Table(model.hashes, np.arange(len(model.hashes))))))
        row = X.scored(odd.sparkSession.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert row.score == pytest.approx(1 - np.prod(1 - p)) and row.n_sentences == len(p)
    got = X.scored(odd, model).collect()
    assert len(got) == len(odd_rows) and all(r.score == 0 for r in got if r.n_sentences == 0)


def test_nothing_to_learn(odd, none, no_labels, spark):
    for labels in (no_labels, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int")):
        model = X.fit(odd, labels)
        assert {(r.score, r.predicted) for r in X.scored(odd, model).collect()} == {(0.0, 0)}
    assert X.scored(none, X.fit(none, no_labels)).count() == 0 and X.sentences(odd, model).count() == 0
