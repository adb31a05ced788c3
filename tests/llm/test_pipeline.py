import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
import tiktoken

import corpus_pipeline as P
from quillframe.llm import bpe, common, exact_dedup, mixing, quality_rules, queries, simhash
from quillframe.llm import wordhash as W
from tests.llm.conftest import words
from tests.llm.test_mixing import size, wanted


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("sf"))
    r, rows = random.Random(1), []
    for i in range(200):
        t = words(i, 70)
        rows.append((i, t.upper().replace(" ", "!! ") if i % 10 == 0 else t, f"s{r.randrange(4)}"))
    rows += [(1000 + k, rows[1][1] + " " * k, "s1") for k in range(5)]  # copies but for spaces
    near = rows[2][1].split()
    rows += [(2000 + k, " ".join([*near[:-1], "zz"]) if k else " ".join(near), "s2") for k in range(2)]
    rows += [(4000 + k, words(9, 1500) + " zz" * k, "s3") for k in range(2)]
    rows += [(3000, None, None), (None, "short", "s0"), (3001, "", "s0")]
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(200) if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def brute_exact(rows):
    """Of rows (id, text, ...), the one that stays of each group of equal texts."""
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        place = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        if key not in best or place < best[key][0]:
            best[key] = (place, r)
    return [r for _, r in best.values()]


def brute_near(rows):
    """Of each component of fingerprints within three bits, the row with the smallest id."""
    fps, left, out = {id(r): simhash.fingerprint((r.text or "").encode()) for r in rows}, list(rows), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            r = todo.pop()
            group.append(r)
            near = [x for x in left if (fps[id(x)] ^ fps[id(r)]).bit_count() <= 3]
            left = [x for x in left if all(x is not y for y in near)]
            todo += near
        out.append(min(group, key=lambda r: (r.doc_id is None, r.doc_id or 0)))
    return out


def same(a, b):
    key = lambda rows: sorted(map(str, rows))
    assert key(a) == key(b)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, outs = docs.columns, []
    assert [n for n, _ in P.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "byte-level BPE"]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        outs.append(docs.collect())
        assert k == 4 or docs.columns == columns
    first, exact, near, mixed, encoded = outs
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality_rules.judged(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    same(first, [r for r in whole.collect() if verdict[r.doc_id]])
    kept = {r.doc_id for r in first}
    assert kept >= {i for i in range(200) if i % 10} and not kept & {3000, 3001, None}  # clean documents stay, empty ones go
    assert sum(i in kept for i in range(0, 200, 10)) <= 2  # rejects go, unlabelled ones by the rules learned
    same(exact, brute_exact(first))
    same(near, brute_near(exact))
    assert len(near) < len(exact) < len(first)
    # the mix: whole copies of rows, totals at the contract's targets
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in near:
        sizes[r.source] += size(r.text)
    for r in mixed:
        taken[r.source] += size(r.text)
    goal = wanted(sizes)
    assert all(abs(taken[s] - t) <= max(0.02 * t, 71) for s, t in goal.items())  # no document is cut
    copies = Counter(map(str, mixed))
    assert set(copies) <= set(map(str, near)) and max(copies.values()) <= 3
    # the ids are the library's, and decode to the text
    path, pattern = bpe.public()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(r.doc_id, len(ids := library.encode_ordinary(r.text)), sha(" ".join(map(str, ids)).encode()), sha(r.text.encode())) for r in mixed]
    same([tuple(r) for r in encoded], want)
    top = os.path.dirname(common.shared_dir(spark).removeprefix("file:"))
    before = set(os.listdir(top))
    same(P.run(spark, sf_dir).collect(), encoded)
    (left,) = set(os.listdir(top)) - before
    assert os.listdir(f"{top}/{left}") == ["3"]  # of all intermediate tables only the one that the last stage reads


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, `n.x` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null beside the text that once stood for it, columns named as the stages name theirs, dots, and a text of more than a chunk."""
    clash = ["id", "no_id", "hash", "row", "kept", "copies", "unit", "counts", "n.x", "__quill_id", "text of the row", "n_words"]
    long = words(7, 480_000)
    assert len(long) > W.CHUNK
    texts = [None, "\0null", "", words(1, 80), words(1, 80), long, words(2, 80)]
    rows = [(k if k != 4 else 3, t, "s", *(f"{c}{k}" for c in clash)) for k, t in enumerate(texts)]
    rows[4] = (3, texts[4], "s", *rows[3][3:])  # a row repeated
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in clash)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    by = {r[0]: r for r in rows}
    for made, want in ((quality_rules.accepted(docs, labels), [3, 3, 5, 6]), (exact_dedup.deduplicated(docs), [0, 1, 3, 5, 6]), (simhash.deduplicated(docs), [0, 1, 3, 5, 6])):
        assert ids(made) == want and made.columns == docs.columns
        assert all(tuple(r) == by[r.doc_id] for r in made.collect())
    drawn = mixing.drawn(docs)
    assert drawn.columns == docs.columns and all(tuple(r) == by[r.doc_id] for r in drawn.collect())
    assert bpe.encoded(docs).columns == [*docs.columns, "ids"] and bpe.encoded(docs).select("row").first()


def test_every_query_runs_and_says_what_it_must(spark, sf_dir):
    must = {
        1: "doc_id held_out score predicted",
        2: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        3: "doc_id size source_size target taken",
        4: "doc_id n_tokens ids_sha256 decoded_sha256",
        5: "doc_id held_out n_tokens n_known train_tokens base_score score",
        6: "doc_id keep_id group_size kept text_sha256",
        7: "doc_id fingerprint component_id",
        8: "doc_id n_bytes n_tokens over_limit",
        9: "doc_id",
        10: "doc_id n_assign n_access n_hex base_sha256 spans",
    }
    made = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in made) == list(range(1, 11))
    for name, f in made.items():
        out = f(spark, sf_dir)
        assert out.count() == 212 and set(must[int(name[2:].split("_")[0])].split()) <= set(out.columns), name
