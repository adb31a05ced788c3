"""Secret scan: fixed patterns, and Shannon entropy in a sliding window over candidate strings. DataFrame functions only.

Base kinds, leftmost and without overlap within a kind: ``assign`` (a password, secret, token or key that is given a value of 6 or
more characters), ``access`` (AKIA and at least 16 capitals or digits), ``hex`` (24 or more of 0-9a-f). The fourth kind,
``entropy``, looks at candidates, maximal runs of a character class (``CLASSES``), through a window of ``WINDOW`` characters. The
window's counts change by one character entering and one leaving, and with them the sum of n log2 n (in fixed point, so no
rounding builds up); its entropy is above the class's threshold where that sum is small enough. A candidate's span goes from the first
window above to the last. The allow-list suppresses entropy spans only: candidates without both a letter and a digit, UUIDs, words and
numbers joined by marks, words that mark samples, and spans that lie whole inside a base span.

Spans are ``kind:start:end`` in code points of the text, end exclusive, by start and then in the kinds' order, comma-joined.

Nulls: a null text is empty and has no spans. A null id passes through. Repeated rows give repeated rows, an empty table an empty
one. Spans that start together come in the order of the kinds; one that two classes find counts once. A long text with many matches is worked
through in runs of ``RUN`` matches, a long candidate in pieces of ``PIECE`` characters that overlap by a window. ``found`` keeps no other
column; its own names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run too short anywhere holds no later match either, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20
#: Class: the pattern of its candidates, and the bits from which a window counts.
CLASSES = {
    "hexdigits": (r"(?<![0-9A-Za-z+/_=-])(?:[0-9a-f]{20,}+|[0-9A-F]{20,}+)(?![0-9A-Za-z+/_=-])", 3.0),
    "base64": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 3.7),
}
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^(?:[a-z]++|[0-9]++)(?:[-_/+=]++(?:[a-z]++|[0-9]++))*+$"  # words and numbers that are only joined
    r"|example|sample|placeholder|dummy|xxxx|012345|123456|abcdef|changeme"
)
_SCALE = 1 << 24
#: n log2 n in fixed point.
N_LOG_N = [0, *(round(n * math.log2(n) * _SCALE) for n in range(1, WINDOW + 1))]
_FIRST, _LAST = ord("+"), ord("z")
_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
#: Matches that are placed, and characters of a candidate that are looked through, at a time: work stays linear in long texts.
RUN, PIECE = 256, 2_000


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _placed(parts: Column, kind: int, keep: Callable[[Column], Column] | None) -> Column:
    """Spans of (m, g, v) structs: matches, what lies before each, and the value that ``keep`` judges."""

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("text")))
        return F.struct(end.alias("at"), (F.when(keep(x["v"]), F.concat(s["out"], one)).otherwise(s["out"]) if keep else F.concat(s["out"], one)).alias("out"))

    def run(parts: Column, run_starts: Column) -> Column:
        first = lambda i: F.struct(F.get(run_starts, i).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(run_starts) - 1), lambda i: F.aggregate(F.slice(parts, i * RUN + 1, RUN), first(i), step, lambda s: s["out"])))

    def starts(parts: Column) -> Column:
        """Where each run of ``RUN`` matches begins."""
        long = lambda i: F.aggregate(F.slice(parts, i * RUN + 1, RUN), F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["m"]))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(parts) / RUN).cast("int") - 2), F.array(F.lit(0)), lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + long(i))))

    one = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda s: s["out"])
    many = _let(parts, lambda p: _let(starts(p), lambda at: run(p, at)))
    return F.when(F.size(parts) <= RUN, one).otherwise(many)


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches as structs, by position: what lies between the matches tells where they are."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), *([F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v")] if keep else []))
    return F.when(text.rlike(pattern), _let(parts, lambda p: _placed(p, kind, keep))).otherwise(F.array().cast(_SPAN))


def _window_range(text: Column, bits: float) -> Column:
    """(first, last) start of the windows of ``text`` above ``bits``, -1 where there's none.

    The counts of a window are a text of one character for each character of the class, so one count is changed in place of another.
    """
    most = math.floor((math.log2(WINDOW) - bits) * WINDOW * _SCALE)
    table = F.array(*(F.lit(x).cast("long") for x in N_LOG_N))
    none, zero = "0" * (_LAST - _FIRST + 1), ord("0")
    count = lambda n, at: F.ascii(F.substring(n, at, 1)) - F.lit(zero)
    put = lambda n, at, c: F.overlay(n, F.char(c + F.lit(zero)), at, F.lit(1))

    def changed(s: Column, enters: Column, leaves: Column, i: Column) -> Column:
        def left(up: Column, n: Column) -> Column:
            total = s["sum"] + F.get(table, up + 1) - F.get(table, up)
            down = F.when(leaves > 0, count(n, leaves)).otherwise(F.lit(1))
            return F.struct(
                F.when(leaves > 0, put(n, leaves, down - 1)).otherwise(n).alias("n"),
                F.when(leaves > 0, total + F.get(table, down - 1) - F.get(table, down)).otherwise(total).alias("sum"),
            )

        def hit(x: Column) -> Column:
            above, at = (i >= WINDOW) & (x["sum"] <= most), i - F.lit(WINDOW)
            return F.struct(x["n"].alias("n"), x["sum"].alias("sum"), F.when(above & (s["first"] < 0), at).otherwise(s["first"]).alias("first"), F.when(above, at).otherwise(s["last"]).alias("last"))

        up = count(s["n"], enters)
        return _let(left(up, put(s["n"], enters, up + 1)), hit)

    def piece(part: Column) -> Column:
        start = F.struct(F.lit(none).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        place = lambda c, i: F.ascii(F.get(c, i - 1)) - F.lit(_FIRST - 1)
        step = lambda c: lambda s, i: changed(s, place(c, i), F.when(i > WINDOW, place(c, i - WINDOW)).otherwise(F.lit(0)), i)
        return _let(F.split(part, ""), lambda c: F.aggregate(F.sequence(F.lit(1), F.length(part)), start, step(c), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))

    def moved(at: Column) -> Column:
        shift = lambda x: F.when(x >= 0, x + at).otherwise(x)
        return _let(piece(F.substring(text, at + 1, F.lit(PIECE + WINDOW - 1))), lambda w: F.struct(shift(w["first"]).alias("first"), shift(w["last"]).alias("last")))

    both = lambda a, w: F.struct(F.when(a["first"] < 0, w["first"]).otherwise(a["first"]).alias("first"), F.greatest(a["last"], w["last"]).alias("last"))
    begin = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.length(text) - WINDOW, F.lit(PIECE)), begin, lambda a, at: both(a, moved(at)))


def _entropy(text: Column, base: Column) -> Column:
    out = []
    for pattern, bits in CLASSES.values():
        likely = F.filter(_spans(text, pattern, 3), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]") & ~x["text"].rlike(ALLOWED))
        ranged = F.transform(likely, lambda x: F.struct(x.alias("x"), _window_range(x["text"], bits).alias("w")))
        kept = F.filter(ranged, lambda y: y["w"]["first"] >= 0)
        out.append(
            F.transform(
                kept,
                lambda y: F.struct((y["x"]["start"] + y["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (y["x"]["start"] + y["w"]["last"] + WINDOW).alias("end"), F.lit("").alias("text")),
            )
        )
    both = F.array_distinct(F.concat(*out))
    return F.filter(both, lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    t = F.col("t")
    df = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = df.select("doc_id", "t", _spans(t, ASSIGN, 0, lambda v: F.length(v) >= 6).alias("a"), _spans(t, ACCESS, 1).alias("k"), _spans(t, HEX, 2).alias("h"))
    df = df.select("doc_id", "t", *(F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))), F.concat("a", "k", "h").alias("base"))
    some = t.rlike("|".join(p for p, _ in CLASSES.values()))
    df = df.withColumn("e", F.when(some, _entropy(t, F.col("base"))).otherwise(F.array().cast(_SPAN)))
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "e")).alias("spans"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return found(C.table(spark, sf_dir, "documents"))
