import random

import numpy as np
import pytest
import sentencepiece

from quillframe.llm import token_counts as X
from tests.llm.test_wordhash import mirrored


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=X.public())


def test_counts_are_the_library_s(library):
    r = random.Random(2)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "b", "the", "of", "▁", "ll", "1", "23", "!", "é", "字", "　", "\xa0", "x'", "\x00", "<s>", "<0x0A>", "</s>", "ﬁ", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4000)] + [" " * 40 + "a" + " " * 100, "", "x" * 5000]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    X.CACHE, keep = 50, X.CACHE  # the cache is emptied again and again
    counter = X.Counter(X.public(), X.Table(np.empty(0, np.uint64), np.empty(0, np.int32)))
    got = counter.count(data, at)
    X.CACHE = keep
    assert got.tolist() == [len(library.encode(t)) for t in texts]


def test_table():
    r = np.random.default_rng(3)
    h = np.unique(r.integers(1, 2**63, 5000, dtype=np.uint64))
    t = X.Table(h[::2], np.arange(len(h[::2])))
    assert (t.find(h[::2]) == np.arange(len(h[::2]))).all() and (t.find(h[1::2]) == -1).all() and t.find(np.zeros(2, np.uint64)).tolist() == [-1, -1]
    same = np.arange(1, 60, dtype=np.uint64) << np.uint64(40)  # all for one slot
    assert (X.Table(same, np.arange(59)).find(same) == np.arange(59)).all()


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_query(odd, odd_rows, none, library, most):
    key = lambda r: tuple((v is None, v) for v in r)
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 100) for r in odd_rows]
    assert sorted((tuple(r) for r in X.counted(odd, 100, most=most).collect()), key=key) == sorted(want, key=key)
    assert X.counted(none).count() == 0


def test_unfit_vocabulary_is_refused(monkeypatch):
    class Fake:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Fake)
    with pytest.raises(ValueError):
        X.library("other")


def test_mirrored_pretokens_and_texts_without_spaces(spark, library):
    """Words that a weak hash merges count apart; long pre-tokens are neither shuffled nor collected."""
    texts = [x for n in (1024, 4096) for x in mirrored(n)] + ["".join(chr(0x4E00 + (i * 7919 + k * k) % 4000) for k in range(20_000)) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in X.counted(docs).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}
    assert X.frequent(docs.union(docs), X.public())[0].size == 0
