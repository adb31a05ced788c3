from pathlib import Path

from quillframe.llm import license_scan as L
from quillframe.llm.license_texts import NOTICES, TEXTS


def test_every_notice_can_be_chosen():
    assert all(L.MENTION in text.lower() for _, text in NOTICES)


def test_variants_of_known_texts(spark):
    mit = dict((n, t) for n, t in TEXTS if n == "MIT")["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\nCOPYRIGHT 2021 Other\n\n" + mit.upper()),
        (2, mit.replace("noninfringement", "non-infringement").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(",", " ,").replace('"', "'")),
        (3, mit + " and more"),
        (4, "Licenced under cc by-nc 4.0\nbody\n  * Released under the MIT Licence. *\nReleased under the MIT License."),
        (5, "released under nothing, license unknown"),
        (6, None),
        (7, ""),
    ]
    got = {r.doc_id: r for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license for k in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert (got[4].n_notices, got[4].notices) == (3, "CC-BY-NC-4.0,MIT") and (got[5].n_notices, got[5].notices) == (0, "")


def test_both_canonical_forms_agree(odd, odd_rows, none):
    got = sorted(r.text_digest for r in L.scanned(odd).collect())
    assert got == sorted(L.digest_of(r[1] or "") for r in odd_rows) and L.scanned(none).count() == 0


def test_whole_licences_inside_documents(spark):
    texts = {n: t for n, t in TEXTS}
    full = "\n".join(f"Clause {k}. Any licence words." + ("\n" if k % 3 == 0 else "") for k in range(40))
    own = [L.entry("Own-1.0", full)]
    head = "# My project\n\nSome words on a license.\n\n"
    rows = [
        (1, head + texts["MIT"] + "\n\nThe end."),
        (2, head + full.upper().replace("LICENCE", "LICENSE") + "\n\n" + texts["Unlicense"]),
        (3, head + full + " more"),  # the last word goes on, after a space: still the whole licence
        (4, head + full.rstrip(".\n") + "more"),
        (5, head + full[:-10]),
        (6, full),
        (7, head.replace("\n", "\r\n") + texts["MIT"].replace("\n", "\r\n")),
    ]
    got = {r.doc_id: r for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string"), digests=own).collect()}
    assert [got[k].embedded for k in range(1, 8)] == ["MIT", "Own-1.0,Unlicense", "Own-1.0", "", "", "Own-1.0", "MIT"]
    assert [got[k].license for k in (1, 6)] == [None, "Own-1.0"]


def test_digests_of_long_licences():
    """Held against the files, where this machine has them."""
    names = {n for n, *_ in L.DIGESTS}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= names
    top = Path("/usr/share/common-licenses")
    if top.is_dir():
        by = {x[3] for x in L.DIGESTS}
        assert all(L.entry("x", (top / f).read_text())[3] in by for f in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"))


def test_sql_gives_the_same_rows(spark, odd_rows):
    import duckdb
    import pyarrow as pa

    texts = [r[1] for r in odd_rows] + [t for _, t in TEXTS] + [f"Intro\n \t\nOn licences.\n\n{t}\r\n\r\nMIT License\n\nReleased under the MIT License." for _, t in TEXTS[::2]] + [t for _, t in NOTICES[:4]]
    rows = list(enumerate(texts))
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array(texts, pa.string())})  # found by DuckDB under its name
    want = duckdb.sql(L.ORACLE).select("doc_id", "text_digest", "license", "embedded", "n_notices", "notices").fetchall()
    got = [tuple(r) for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and sum(bool(r[3]) for r in got) >= len(TEXTS) and documents.num_rows == len(rows)
