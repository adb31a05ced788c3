import hashlib
import random

import pytest
import tiktoken

from quillframe.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.public())


@pytest.fixture(scope="module")
def library():
    import base64

    path, pattern = bpe.public()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 17])
def test_tree_equals_the_library(codec, library, leaf):
    r = random.Random(leaf)
    parts = [" ", "  ", "\n", "\r\n", "\t", "a", "b", "the", " of", "'", "'l", "ll", "1", "23", "!", "é", "字", "　", "\xa0", "x'", "\x1c", "\x85", "<|endoftext|>", "😀"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        ids = codec.encode(text, leaf)
        assert ids == library.encode_ordinary(text), (text, leaf)
        assert codec.decode(ids, leaf) == text.encode()


def test_long_texts(codec, library):
    for text in ("ab" * 30_000, "word and more " * 3_000, " " * 20_000, "x" + "\n" * 9_000 + "y", "字" * 10_000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_queries(odd, odd_rows, none, codec, library):
    def row(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in bpe.digests(odd).collect()), key=key) == sorted((row(*r[:2]) for r in odd_rows), key=key)
    assert bpe.digests(none).count() == 0
    ids = bpe.encoded(odd, "hash")  # takes the place of a column of that name
    assert set(ids.columns) == set(odd.columns)
    back = bpe.decoded(ids, "hash")
    assert sorted(bytes(r.text) for r in back.collect()) == sorted((r[1] or "").encode() for r in odd_rows)
