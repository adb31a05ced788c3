"""Licence scan by canonical digests: a text is known when its canonical form has the digest of a known licence's.

The canonical form lower-cases, deletes copyright lines, reduces equivalent spellings to one and turns every run of characters other than
letters and digits into one space. Texts are joined whole to the known digests. The known table is of fixed size, so the join is a
broadcast hash join. The same digests find a whole licence inside a longer document: the document is cut at blank lines, and where the
canonical form of a block has the digest of a licence's first block, as many characters of the canonical text from there on as the
licence has are hashed and compared to its digest. Licences that are only named are found by the lines that have the word licence and
the digest of a known notice. Long licences are kept as digests alone (``DIGESTS``), short ones and notices as texts; callers add their own.

Nulls: a null text is empty and matches nothing. A null id passes through. Repeated rows give repeated rows, an empty table
an empty one. Of licences of one digest the one that is listed last counts. A text of any length is hashed whole. ``scanned`` keeps no other
column, whatever its name.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C
from quillframe.llm.license_texts import DIGESTS, NOTICES, TEXTS

#: A line that only says whose the text is.
COPYRIGHT = r"(^|\n)[^\na-z0-9]*(copyright|copr|©|\(c\))[^\n]*"
#: Equivalent spellings, each to the form that stays.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("judgement", "judgment"),
    ("fulfilment", "fulfillment"),
    ("merchantibility", "merchantability"),
    ("https:", "http:"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("&", " and "),
]
PUNCTUATION = r"[^\p{L}\p{N}]+"
MENTION = "licen"
#: Texts without any of these hold no known licence.
LIKELY = r"licen|redistribut|permission|warrant|public domain"
BLANK = r"\n[\x20\x09\x0B-\x0D]*\n"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), COPYRIGHT, "\n")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, PUNCTUATION, " "))


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts."""
    import regex

    t = re.sub(COPYRIGHT, "\n", "\n" + text.lower())
    for old, new in SPELLINGS:
        t = t.replace(old, new)
    return regex.sub(PUNCTUATION, " ", t).strip(" ")


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known(entries: list[tuple[str, str]]) -> dict[str, str]:
    """Digest to licence."""
    return {digest_of(text): name for name, text in entries}


def entry(name: str, text: str) -> tuple[str, str, int, str]:
    """(id, digest of the first block, characters, digest) of a licence's canonical text."""
    whole = canonical_text(text)
    first = next(x for x in map(canonical_text, re.split(BLANK, text)) if x)
    return name, hashlib.sha256(first.encode()).hexdigest(), len(whole), hashlib.sha256(whole.encode()).hexdigest()


def _embedded(text: Column, entries: list[tuple[str, str, int, str]]) -> Column:
    """Licences whose whole canonical text begins with a block of ``text``, sorted, without repeats."""
    by: dict[str, list] = {}
    for name, first, n, digest in entries:
        by.setdefault(first, []).append(F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"), F.lit(digest).alias("digest")))
    table = F.create_map(*(x for first, known in sorted(by.items()) for x in (F.lit(first), F.array(*known))))
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a value that is computed once
    none = F.array().cast("array<string>")

    def at(blocks: Column, i: Column) -> Column:
        def held(known: Column) -> Column:
            rest = F.array_join(F.slice(blocks, i + 1, F.size(blocks)), " ")
            same = lambda r: lambda k: (F.sha2(F.substring(r, F.lit(1), k["n"]), 256) == k["digest"]) & F.substring(r, k["n"] + 1, F.lit(1)).isin("", " ")
            return F.when(known.isNull(), none).otherwise(let(rest, lambda r: F.transform(F.filter(known, same(r)), lambda k: k["name"])))

        return let(F.element_at(table, F.sha2(F.get(blocks, i), 256)), held)

    blocks = F.filter(F.transform(F.split(text, BLANK), canonical), lambda x: x != "")
    return let(blocks, lambda b: F.array_sort(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: at(b, i))))))


def scanned(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str, int, str]] = DIGESTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_digest (of the canonical text), license (of the whole text, or null), embedded (licences whose
    whole text stands in it from a blank line on, sorted, without repeats, comma-joined), n_notices (lines that are known notices), notices (their licences likewise)."""
    spark = docs.sparkSession
    entries = [*digests, *(entry(*x) for x in texts)]
    pairs = F.array(*(F.struct(F.lit(d).alias("text_digest"), F.lit(n).alias("license")) for d, n in sorted({x[3]: x[0] for x in entries}.items())))
    whole = spark.range(1).select(F.inline(pairs))
    lines = known([*texts, *notices])
    table = F.create_map(*(F.lit(x) for kv in sorted(lines.items()) for x in kv))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", t.alias("t")).select("doc_id", F.sha2(canonical(F.col("t")), 256).alias("text_digest"), F.when(F.lower("t").rlike(LIKELY), F.col("t")).alias("t"))
    named = F.filter(F.split("t", "\n"), lambda x: F.lower(x).contains(MENTION))
    hits = F.filter(F.transform(named, lambda x: F.element_at(table, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    df = df.select("doc_id", "text_digest", F.coalesce(hits, none).alias("hits"), F.when(F.col("t").isNull(), none).otherwise(_embedded(F.col("t"), entries)).alias("held"))
    df = df.join(F.broadcast(whole), "text_digest", "left")  # a table of fixed size
    return df.select(
        "doc_id", "text_digest", "license", F.array_join("held", ",").alias("embedded"), F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices")
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    t = f"regexp_replace(chr(10) || lower({column}), {_sql_text(COPYRIGHT)}, chr(10), 'g')"
    for old, new in SPELLINGS:
        t = f"replace({t}, {_sql_text(old)}, {_sql_text(new)})"
    return f"trim(regexp_replace({t}, {_sql_text(PUNCTUATION)}, ' ', 'g'))"


def _values(entries: dict[str, str]) -> str:
    return ", ".join(f"({_sql_text(d)}, {_sql_text(n)})" for d, n in sorted(entries.items()))


_ENTRIES = [*DIGESTS, *(entry(*x) for x in TEXTS)]
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
whole(h, license) AS (VALUES {_values({x[3]: x[0] for x in _ENTRIES})}),
lines(h, name) AS (VALUES {_values(known([*TEXTS, *NOTICES]))}),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d WHERE contains(lower(t), '{MENTION}')),
m AS (SELECT r, name FROM (SELECT r, sha256({_sql_canonical("line")}) AS h FROM l WHERE contains(lower(line), '{MENTION}')) JOIN lines USING (h)),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m GROUP BY r),
entries(name, first, size, h) AS (VALUES {", ".join(f"({_sql_text(n)}, '{f}', {k}, '{h}')" for n, f, k, h in _ENTRIES)}),
cut AS (SELECT r, [x FOR x IN [{_sql_canonical("y")} FOR y IN regexp_split_to_array(t, {_sql_text(BLANK)})] IF x <> ''] AS blocks FROM d WHERE regexp_matches(lower(t), {_sql_text(LIKELY)})),
spots AS (SELECT r, i, sha256(blocks[i]) AS first, array_to_string(blocks[i:], ' ') AS rest FROM (SELECT r, blocks, unnest(generate_series(1, len(blocks))) AS i FROM cut)),
e AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM spots JOIN entries USING (first)
      WHERE sha256(substr(rest, 1, size)) = h AND substr(rest, size + 1, 1) IN ('', ' ') GROUP BY r),
g AS (SELECT r, doc_id, sha256({_sql_canonical("t")}) AS h FROM d)
SELECT doc_id, h AS text_digest, license, coalesce(e.names, '') AS embedded, coalesce(n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM g LEFT JOIN whole USING (h) LEFT JOIN n USING (r) LEFT JOIN e USING (r)
"""


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(C.table(spark, sf_dir, "documents"))
