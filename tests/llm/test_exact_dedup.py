import hashlib
import random
import re
from collections import defaultdict

import pytest

from quillframe.llm import exact_dedup as X

SPACE = r"[\x20\x09-\x0D]"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(SPACE, "", r[1] or "")].append(r)
    out = []
    for key, group in groups.items():
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(group), hashlib.sha256(key.encode()).hexdigest()) for r in group]
    return out


def order(x):
    return sorted(x, key=lambda r: tuple((v is None, v) for v in r))


def test_against_brute_force(odd, odd_rows):
    got = X.classes(odd).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(brute(odd_rows))
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r.kept)
        assert not r.kept or r.doc_id == r.keep_id
    assert all(sum(k) == 1 for k in by.values())


def test_deduplicated_keeps_columns_and_one_row(odd, odd_rows, none):
    out = X.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len({re.sub(SPACE, "", r[1] or "") for r in odd_rows})
    assert X.deduplicated(none).count() == 0 and X.classes(none).count() == 0


@pytest.mark.parametrize("skip", [0, 5])
def test_index_splits_chains_and_compares_bytes(skip, tmp_path):
    r, index, want = random.Random(skip), X.Index(capacity=4, skip=skip), {}
    keys = [r.getrandbits(64 - skip) for _ in range(300)] + [12345] * 5  # few keys, so that many digests collide on them
    for n in range(4000):
        key, digest = keys[r.randrange(len(keys))], bytes([r.randrange(6)]) * 32
        best = (-r.randrange(50), r.randrange(9), n)
        index.add(key, digest, 1, best)
        have = want.setdefault((key, digest), [0, best])
        have[0] += 1
        have[1] = min(have[1], best)
    assert {(e[0], e[1]): [e[2], e[3]] for e in index.entries()} == want
    assert len(index.directory) == 1 << index.depth and index.depth > 3
    for b in index.buckets():
        assert len(b[1]) <= 4 or len({e[0] for e in b[1]}) == 1
    uri = f"file://{tmp_path}/i.xhix"
    index.save(uri)
    stored = X.Index.open(uri)
    assert all(stored.find(k, d) == (n, best[1], -best[0]) for (k, d), (n, best) in want.items())
    assert stored.find(1, b"\xff" * 32) is None


def test_later_batch_finds_known_texts(spark, tmp_path):
    first = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    X.classes(first, index_dir=f"file://{tmp_path}").collect()
    bits = (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    later = spark.createDataFrame([(100, "te xt\n7"), (101, "new")], "doc_id long, text string")
    assert sorted(map(tuple, X.duplicates_of(later, f"file://{tmp_path}", bits).collect())) == [(100, 7), (101, None)]
