import random

import numpy as np

from quillframe.llm import toxicity as X
from tests.llm.conftest import words


def test_sample_of_each_class_keeps_the_true_balance(spark):
    """A word in all toxic texts and in one of three clean ones: one text in ten is toxic, so with the word alone one in four is."""
    r, rows = random.Random(5), []
    for i in range(4000):
        toxic = i % 10 == 0
        rows.append((i, words(i, 8) + (" grumbolt" if toxic or r.random() < 1 / 3 else ""), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "grumbolt")], "doc_id long, text string")
    whole, part = (X.scored(probe, X.fit(docs, labels, most=n)).first() for n in (10_000, 300))
    assert whole.predicted == part.predicted == 0
    assert abs(whole.score - part.score) < 0.15


def test_a_weight_is_as_many_rows():
    doc, sentence, feature = (np.array(x) for x in ([0, 1, 2], [0, 1, 2], [0, 0, 1]))
    label, one = np.array([True, False, False]), np.ones(4, int)
    a = X.train(doc, sentence, feature, one[:3], label, 2, np.array([1, 1, 2]))
    b = X.train(np.r_[doc, 3], np.r_[sentence, 3], np.r_[feature, 1], one, np.r_[label, False], 2)
    assert np.allclose(a[0], b[0]) and np.isclose(a[1], b[1])
