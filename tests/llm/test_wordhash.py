import numpy as np

from quillframe.llm import quality_rules as Q
from quillframe.llm import wordhash as W
from tests.llm.conftest import words


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def test_equal_words_have_equal_hashes_wherever_they_lie():
    texts = ["a bb\ta", "", "bb  a", " ", "A", "é bb"]
    w = W.words(*flat(texts))
    names = [x for t in texts for x in t.split()]
    by = {}
    for n, h in zip(names, w.hashes.tolist(), strict=True):
        assert by.setdefault(n, h) == h
    assert len(set(by.values())) == len(by) and w.doc.tolist() == [0, 0, 0, 2, 2, 4, 5, 5]
    low = W.words(*flat(texts), lower=True)
    assert low.hashes[5] == low.hashes[0]


def test_a_long_text_is_hashed_as_a_short_one(monkeypatch):
    data, at = flat([words(3, 4000) + " " + "y" * 900 + "\n" + words(3, 50)])
    whole, stats = W.words(data, at).hashes, Q.counts(data, at)
    monkeypatch.setattr(W, "CHUNK", 64)
    assert (W.words(data, at).hashes == whole).all() and (Q.counts(data, at) == stats).all()


def mirrored(n, a="a", b="b"):
    """Two words that collide under any polynomial hash modulo a power of two."""
    word = "".join(b if k.bit_count() & 1 else a for k in range(n))
    return word, word.translate(str.maketrans(a + b, b + a))


def test_mirrored_words_differ():
    for n in (8, 64, 256, 257, 1024, 2048, 4096):
        one, other = mirrored(n)
        w = W.words(*flat([one, other, f"{one} {other}"]))
        assert w.hashes[0] != w.hashes[1] and w.hashes[2:].tolist() == w.hashes[:2].tolist()
        stats = Q.counts(*flat([f"{one}\n{other}\n{one}"]))[0]
        assert stats[Q.COUNTS.index("n_dup_lines")] == 1 and stats[Q.COUNTS.index("n_distinct_words")] == 2


def test_bytes_past_the_end_of_a_word_have_no_say():
    w = W.words(*flat(["abc", "abc d", "abc\x00", "abc\x00\x00", "abcdefgh", "abcdefgh\x00"]))
    assert w.hashes[0] == w.hashes[1] and len(set(w.hashes.tolist())) == 6
