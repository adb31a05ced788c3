"""Quality rules: a learned decision list over document statistics.

Words are ``[^\\x20\\x09-\\x0D]+``. Every whole text gives counts (``statistics``); the rules are conjunctions of thresholds on
ratios of them. Sequential covering grows one conjunction at a time on two thirds of the labelled rows, adding the threshold with
the largest gain in information, prunes it from the end on the remaining third, keeps it if it is precise enough there, and goes
on with the rows it doesn't cover. The rules come out in that order as one Spark conditional expression, so scoring
runs in the JVM and a rule can be read, edited and stored.

The base rule comes first: fewer than 50 words, or more than half of the words in repeated 3-word windows, fail.

Nulls: a null text has no words and fails the base rule; rows without a label are not learned from; a table of labels
without both classes gives no rules. Repeated rows count one by one; equal lines and windows are told by 64-bit hashes of their words. Of
thresholds or prunings of equal worth the first counts. A text of any length is counted whole, as a chunk of its own. An empty table gives
an empty result. Extra columns of any name are ignored by ``judged`` and kept by ``accepted``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C
from quillframe.llm import wordhash as W

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words"]
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(range(65, 91))] = True
_DIGIT[list(range(48, 58))] = True
_MARK[list(b"!?")] = True
#: Labelled rows that the rules are learned from at most, by a hash of the id.
LEARN_ROWS = 20_000
#: Rows of the pruning third that a rule must cover, and its least share of rejects there.
LEAST_COVER, LEAST_PRECISION = 3, 0.95
MAX_RULES, MAX_TERMS, CUTS = 24, 4, 64


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``COUNTS`` of every text of a chunk, one column each."""
    n = len(at) - 1
    w = W.words(data, at)
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.bincount(w.doc, minlength=n)
    inside = ~W.SPACE[data]
    out[:, 1] = W.per_row(inside & ((data & 0xC0) != 0x80), at)
    for k, x in ((2, _SYMBOL), (6, _UPPER), (7, _DIGIT), (8, _MARK)):
        out[:, k] = W.per_row(x[data], at)
    # lines with a word, as spans between line feeds
    starts, ends = W.edges(data != 0x0A, at)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    full = words_before[ends] > words_before[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(at[1:], starts, "right")
    out[:, 5] = np.bincount(doc, minlength=n)
    out[:, 3] = out[:, 5] - _distinct(W.span_hashes(data, starts, ends), doc, n)
    out[:, 9] = _distinct(w.hashes, w.doc, n)
    if len(w.doc) > 2:
        third = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        key = W.join2(W.join2(w.hashes[third], w.hashes[third + 1]), w.hashes[third + 2] ^ W.mix(w.doc[third].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        covered = np.zeros(len(w.doc), bool)
        for k in range(3):
            covered[third[again] + k] = True
        out[:, 4] = np.bincount(w.doc[covered], minlength=n)
    return out


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(n, np.int64)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def _counts_of(texts: pa.Array) -> np.ndarray:
    data, at = C.text_bytes(texts)
    return np.concatenate([counts(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in C.chunks(at, W.CHUNK)] or [np.empty((0, len(COUNTS)), np.int64)])


def _count_batch(first: int):
    """Counts of the last column; the ``first`` columns pass through."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = _counts_of(b.column(first))
            return pa.RecordBatch.from_arrays([*b.columns[:first], *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*b.schema.names[:first], *COUNTS])

        return f

    return make


def statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """The columns ``keys`` and the counts of every row's ``text``."""
    thin = docs.select(*keys, F.col("text").cast("string").alias("text of the row"))
    schema = ", ".join(f"`{c}` {t}" for c, t in thin.dtypes[:-1]) + "".join(f"{', ' if keys or k else ''}{c} long" for k, c in enumerate(COUNTS))
    return C.arrow_map(thin, _count_batch(len(keys)), schema)


def ratios() -> dict[str, Column]:
    """What rules test. A text without words has ratio 0 throughout."""
    c = {x: F.col(x).cast("double") for x in COUNTS}
    by = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)
    return {
        "n_words": c["n_words"],
        "mean_word": by("word_chars", "n_words"),
        "symbols": by("n_symbols", "n_words"),
        "dup_lines": by("n_dup_lines", "n_lines"),
        "repeats": by("n_repeat_words", "n_words"),
        "upper": by("n_upper", "word_chars"),
        "digits": by("n_digits", "word_chars"),
        "marks": by("n_marks", "n_words"),
        "distinct": by("n_distinct_words", "n_words"),
    }


Rule = list[tuple[str, str, float]]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        out &= v > cut if op == ">" else v <= cut
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_TERMS and (~bad & inside).any() and (bad & inside).any():
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, name in enumerate(names):
            v, y = x[inside, j], bad[inside]
            edges = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1]))
            # counts beyond each cut come from one sort
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], edges, "right")
            good = np.concatenate([[0], np.cumsum(y[order])])
            for op, p, n in ((">", p0 - good[at], (len(v) - at) - (p0 - good[at])), ("<=", good[at], at - good[at])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], (name, op, float(edges[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers(rule[-1:], x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, turn: np.ndarray, names: list[str]) -> list[Rule]:
    """The ordered rules that reject. ``turn``: any number of each row; those divisible by 3 prune, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & (turn % 3 != 0), left & (turn % 3 == 0)
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow(x[grow], bad[grow], names)
        worth: list[tuple[float, float, int, Rule]] = []
        for k in range(len(rule), 0, -1):
            c = covers(rule[:k], x[prune], names)
            p, n = int((c & bad[prune]).sum()), int((c & ~bad[prune]).sum())
            worth.append(((p - n) / max(1, p + n), p / max(1, p + n), p, rule[:k]))
        if not worth:
            break
        _, precision, p, rule = max(worth, key=lambda z: z[:3])
        if precision < LEAST_PRECISION or p < LEAST_COVER:
            break
        rules.append(rule)
        left &= ~covers(rule, x, names)
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as a conditional expression over ``ratios()``: the number of the first rule that rejects, or null."""
    tests, out = ratios(), None
    for k, rule in enumerate(rules):
        hit = F.lit(True)
        for name, op, cut in rule:
            hit = hit & (tests[name] > cut if op == ">" else tests[name] <= cut)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def fit(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> list[Rule]:
    """Rules from at most ``most`` labelled rows (the smallest hashes of their ids); ``quality`` 0 is a reject."""
    spark = docs.sparkSession
    some = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    ids = C.written(some, f"{C.shared_dir(spark)}/ids")
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # at most LEARN_ROWS ids
    tests = ratios()
    rows = statistics(part, "doc_id", "quality").select(F.xxhash64("doc_id", F.lit(1)).alias("turn"), "doc_id", "quality", *(v.alias(k) for k, v in tests.items())).toPandas()
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return learn(rows[list(tests)].to_numpy(float), (rows["quality"] == 0).to_numpy(), rows["turn"].to_numpy(), list(tests))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, *keys: str, rules: list[Rule] | None = None) -> DataFrame:
    """``keys`` (doc_id by default), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (the first that rejects)."""
    rules = fit(docs, labels) if rules is None else rules
    out = statistics(docs, *(keys or ("doc_id",))).withColumns({"base_failed": base_failed(), "rule": expression(rules)})
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(*(keys or ("doc_id",)), *COUNTS[:5], "base_failed", "kept", "rule")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Only texts go to Python, and only counts come back."""
    rules = fit(docs, labels)
    C.ship(docs.sparkSession)

    def count(text: pa.Array) -> pa.Array:
        found = _counts_of(text)
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(COUNTS))], names=COUNTS)

    count.__annotations__ = {"text": pa.Array, "return": pa.Array}  # not as texts: Spark reads them
    counted = F.arrow_udf(count, ", ".join(f"{c} long" for c in COUNTS))
    rows = docs.select(F.struct(*map(C.name, docs.columns)).alias("row"), counted(F.col("text").cast("string")).alias("counts")).select("row", "counts.*")
    return rows.filter(~base_failed() & expression(rules).isNull()).select("row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "labels"))
