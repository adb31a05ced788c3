"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only the document has a label.

A sentence ends at ``. ! ?`` or a line feed; its features are the distinct words (runs of letters, A-Z lower-cased) it holds and
their first ``STEMS`` bytes, which inflected forms share, all by hash.
A sentence with features x is toxic with probability p = sigmoid(b + w.x), and a document with 1 - prod(1 - p), the
noisy-or of its sentences. Both are trained on document labels alone, by gradient steps with a soft threshold that leaves only
telling words a weight. ``sentences`` then says which sentences of a document made its score.

Labels are learned from a bounded sample: at most ``LEARN_ROWS`` labelled rows of either class, those with the smallest hashes of
their ids, outside the held-out fold. Each sampled row weighs as many rows of its class as it stands for, so the balance of the classes is that of all
training labels, whatever the size of the input. ``LEARN_HITS`` bounds what the sample's longest texts send to the driver. Candidates for weights are the ``FEATURES`` words that tell the classes apart best there, by ``LEAST_APART`` standard errors or more.

Nulls: a null text is empty. A text without words has no sentence and scores 0. A null id counts as the empty text for the fold.
Repeated rows score alike; of sentences that are equally bad the first is the worst. A text of any length is scored whole. Without labels of both classes nothing is learned: every text scores 0. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm import common as C
from quillframe.llm import wordhash as W
from quillframe.llm.token_counts import Table

LEARN_ROWS, FEATURES, LEAST_ROWS = 6_000, 4_096, 5
#: Candidates in sentences that the driver learns from at most: sampled rows with the largest hashes go if there are more.
LEARN_HITS = 8_000_000
#: Standard errors by which a word's share of toxic documents must differ from the whole sample's.
LEAST_APART = 6.0
FOLDS = 5
STEPS, RATE, SPARSE = 500, 0.1, 2e-4
#: Share of labels taken to be wrong, so that no single one pulls without limit.
WRONG = 0.02
STEMS = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


class Model(NamedTuple):
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


class Bags(NamedTuple):
    """Features of a chunk and their sentences; sentences of a document follow each other."""

    words: W.Words
    sentence: np.ndarray  # of each feature
    doc: np.ndarray  # of each sentence
    spans: np.ndarray  # first and last byte of each sentence's words


def bags(data: np.ndarray, at: np.ndarray) -> Bags:
    starts, ends = W.edges(_LETTER[data], at)
    doc = np.searchsorted(at[1:], starts, "right")
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=before[1:])
    new = np.ones(len(starts), bool)
    new[1:] = (before[starts[1:]] != before[starts[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    low, sentence = W.LOWER[data], np.cumsum(new) - 1
    parts = [(W.span_hashes(low, starts, ends), np.arange(len(starts)))]
    for n in STEMS:
        long = np.flatnonzero(ends - starts >= n)
        parts.append((W.mix(W.span_hashes(low, starts[long], starts[long] + n) + np.uint64(n)), long))
    hashes, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Bags(W.Words(hashes, doc[of], starts[of], ends[of]), sentence[of], doc[first], np.stack([starts[first], ends[last]], 1) if len(first) else np.empty((0, 2), np.int64))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _distinct(sentence: np.ndarray, feature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(sentence.astype(np.int64) * width + feature)
    return key // width, key % width


def activations(bag: Bags, model: Model, table: Table) -> np.ndarray:
    """b + w.x of every sentence."""
    z = np.full(len(bag.doc), model.bias)
    if len(model.hashes) and len(bag.words.hashes):
        k = table.find(bag.words.hashes)
        hit = k >= 0
        s, f = _distinct(bag.sentence[hit], k[hit], len(model.hashes))
        z += np.bincount(s, model.weights[f], minlength=len(z))
    return z


def train(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, sentences: np.ndarray, label: np.ndarray, features: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias; ``weight``: of each document in the loss, 1 by default. The first three name the features of each sentence (numbered over all documents); ``sentences`` counts those of each document."""
    n, held = len(label), int(sentence.max()) + 1 if len(sentence) else 0
    of = np.zeros(held, np.int64)
    of[sentence] = doc
    plain = sentences - np.bincount(of, minlength=n)  # sentences without a candidate word
    w, b = np.zeros(features), -5.0
    m1, m2 = np.zeros(features + 1), np.zeros(features + 1)
    y = label.astype(bool)
    part = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    for t in range(1, STEPS + 1):
        z = b + np.bincount(sentence, w[feature], minlength=held)
        total = np.bincount(of, _softplus(z), minlength=n) + plain * _softplus(b)
        clean = np.exp(-total)
        said = WRONG + (1 - 2 * WRONG) * (1 - clean)  # of being labelled toxic
        slope = (1 - 2 * WRONG) * clean * np.where(y, -1 / said, 1 / (1 - said)) * part
        dz = slope[of] / (1 + np.exp(-z))
        g = np.append(np.bincount(feature, dz[sentence], minlength=features), dz.sum() + (slope * plain).sum() / (1 + np.exp(-b)))
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        step = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
        # the soft threshold of the same step size
        shrink = RATE * SPARSE / (np.sqrt(m2[:-1] / (1 - 0.99**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS, folds: int = FOLDS) -> Model:
    """Learns from rows outside fold 0; see the module for the sample's bound."""
    spark = docs.sparkSession
    to = C.shared_dir(spark)
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).alias("toxic")).filter(C.fold(F.col("doc_id"), folds) != 0)
    known = known.withColumn("h", F.xxhash64("doc_id"))
    all_of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    some = [known.filter(x).orderBy("h", "doc_id").limit(most) for x in ("toxic", "not toxic")]
    ids = C.written(some[0].unionByName(some[1]), f"{to}/ids")
    sampled = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if len(sampled) < 2:
        return Model(np.empty(0, np.uint64), np.empty(0), -np.inf)
    heavy = {k: all_of[k] / n for k, n in sampled.items()}  # rows of its class that a sampled one stands for
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most two samples of ids
    part = C.written(part.select("doc_id", "toxic", "text"), f"{to}/sample")

    def seen():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(1))
            toxic, out = np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool), []
            for i, j in C.chunks(at, W.CHUNK):
                w = bags(data[at[i] : at[j]], at[i : j + 1] - at[i]).words
                order = np.lexsort((w.doc, w.hashes))
                h, d = w.hashes[order], w.doc[order] + i
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                u, back = np.unique(h[new], return_inverse=True)
                out.append((u, np.bincount(back, toxic[d[new]], minlength=len(u)), np.bincount(back, minlength=len(u))))
            u, a, n = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "a", "n"])

        return f

    sizes = part.agg(F.sum(F.col("toxic").cast("long")), F.count("*")).first()
    toxic, rows = int(sizes[0] or 0), int(sizes[1])
    if not 0 < toxic < rows:
        return Model(np.empty(0, np.uint64), np.empty(0), -np.inf)
    found = C.arrow_map(part.select("toxic", "text"), seen, "h long, a long, n long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    # the root of chi-square of the word and the label; how common the word is comes from the classes at their true balance
    yes, no, share = heavy[True], heavy[False], toxic / rows
    n = (F.col("a") * yes + (F.col("n") - F.col("a")) * no) * (rows / (yes * toxic + no * (rows - toxic)))
    apart = F.abs((F.col("a") - F.col("n") * share) / F.sqrt(n * share * (1 - share) * (1 - n / (rows + 1))))
    top = found.filter(apart >= LEAST_APART).orderBy(apart.desc(), "h").limit(FEATURES).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    names = np.sort(top)

    def features():
        table = Table(names, np.arange(len(names)))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(2))
            out, count = [], []
            for i, j in C.chunks(at, W.CHUNK):
                bag = bags(data[at[i] : at[j]], at[i : j + 1] - at[i])
                k = table.find(bag.words.hashes)
                hit = k >= 0
                s, x = _distinct(bag.sentence[hit], k[hit], max(1, len(names)))
                d = bag.doc[s]  # s ascends, so d does
                cut = np.searchsorted(d, np.arange(j - i + 1))
                count.append(np.bincount(bag.doc, minlength=j - i))
                out += [(s[p:q].astype(np.int32).tobytes(), x[p:q].astype(np.int32).tobytes()) for p, q in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(count)), *(pa.array([x[k] for x in out], pa.binary()) for k in range(2))], names=["doc_id", "toxic", "n", "s", "f"])

        return f

    rows = C.written(C.arrow_map(part, features, "doc_id long, toxic boolean, n long, s binary, f binary"), f"{to}/features")
    thin = rows.groupBy("doc_id").agg(F.sum(F.length("s") / 4).alias("hits"))  # of two samples of ids
    upto = F.sum("hits").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(thin.withColumn("upto", upto).filter(F.col("upto") <= LEARN_HITS), "doc_id", "left_semi").toPandas()
    if not 0 < rows["toxic"].sum() < len(rows):
        return Model(np.empty(0, np.uint64), np.empty(0), -np.inf)
    rows = rows.sort_values(["doc_id", "toxic", "n", "s"]).reset_index(drop=True)
    s = [np.frombuffer(x, np.int32) for x in rows["s"]]
    f = np.concatenate([np.frombuffer(x, np.int32) for x in rows["f"]]).astype(np.int64)
    doc = np.repeat(np.arange(len(s)), [len(x) for x in s])
    _, sentence = np.unique(doc.astype(np.int64) << 32 | np.concatenate(s), return_inverse=True)
    y = rows["toxic"].to_numpy(bool)
    yes, no = (all_of[x] / (y == x).sum() for x in (True, False))
    w, b = train(doc, sentence, f, rows["n"].to_numpy(), y, len(names), np.where(y, yes, no))
    return Model(names[w != 0], w[w != 0], b)


def scored(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_sentences, and the worst sentence's span in code points (null without sentences)."""

    def make():
        table = Table(model.hashes, np.arange(len(model.hashes)))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(2))
            n = b.num_rows
            score, count, worst = np.zeros(n), np.zeros(n, np.int64), np.full((n, 2), -1, np.int64)
            for i, j in C.chunks(at, W.CHUNK):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                bag = bags(part, own)
                if not len(bag.doc):
                    continue
                z = activations(bag, model, table)
                score[i:j] = -np.expm1(-np.bincount(bag.doc, _softplus(z), minlength=j - i))
                count[i:j] = np.bincount(bag.doc, minlength=j - i)
                order = np.lexsort((-np.arange(len(z)), z, bag.doc))  # the first of the worst
                top = order[np.searchsorted(bag.doc[order], np.arange(j - i), "right") - 1]
                has = count[i:j] > 0
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                worst[i:j][has] = (points[bag.spans[top]] - points[own[:-1]][:, None])[has]
            none = worst[:, 0] < 0
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), pa.array(worst[:, 0], mask=none), pa.array(worst[:, 1], mask=none)], names=["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end"])

        return f

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (C.fold(F.col("doc_id"), folds) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return C.arrow_map(thin, make, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_start long, worst_end long")


def sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Sentences whose own probability is ``least`` or more: doc_id, start and end (code points), sentence, p."""

    def make():
        table = Table(model.hashes, np.arange(len(model.hashes)))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(1))
            out = []
            for i, j in C.chunks(at, W.CHUNK):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                bag = bags(part, own)
                p = 1 / (1 + np.exp(-activations(bag, model, table)))
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                for k in np.flatnonzero(p >= least):
                    d, (s, e) = bag.doc[k], bag.spans[k]
                    out.append((b.column(0)[i + int(d)].as_py(), int(points[s] - points[own[d]]), int(points[e] - points[own[d]]), part[s:e].tobytes().decode(), float(p[k])))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "end", "sentence", "p"])

        return f

    return C.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, start long, end long, sentence string, p double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, C.table(spark, sf_dir, "labels")))
