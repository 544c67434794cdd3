"""Toxicity by multiple-instance learning.

A document is a bag of sentences, toxic if one of its sentences is. A sentence's
score is a logistic function of its words and word beginnings; noisy-or combines
the scores of a document's sentences: 1 - product(1 - score). Only documents
have labels. The gradient of their likelihood shares each label out among the
sentences, so that training finds the offending ones.

Training takes at most SAMPLE labelled rows to the driver (see shared.sample);
features are the at most FEATURES hashes of words and of their first 4 to 7
bytes that toxic documents hold far more often than others.

Results: a null or empty text scores as one empty sentence, a text of any
length by all its sentences. Without labels of both kinds the score is the
share of toxic labels (0 without labels). Repeated rows are scored each; other
columns are ignored. A null doc_id isn't held out; labels with a null doc_id or
a null label are ignored, the larger of several labels counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared
from strikeflow.llm import textbytes as tb

SAMPLE, FEATURES = 8000, 4000
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
STEPS, RATE, DECAY = 800, 0.1, 1e-5
SLOTS = 20

_SPLIT = np.ones(256, bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _SPLIT[_a:_b] = False
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 59, 63]] = True


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes and the sentence of each; the document, start and end (bytes in the text) of each sentence. Each text has a sentence at least."""
    buf, offs = tb.to_bytes(column)
    buf = tb.LOWER[buf]
    n = len(offs) - 1
    stops = np.flatnonzero(_STOP[buf]) + 1
    begins = np.concatenate([offs[:-1], stops])
    starts = np.unique(begins[begins < len(buf)]) if len(buf) else offs[:1]  # an empty text at the end begins past it
    doc = np.searchsorted(offs, starts, "right") - 1
    empty = np.flatnonzero(np.diff(offs) == 0)  # these share their start with the text after them
    word = ~_SPLIT[buf]
    first, last = word.copy(), word.copy()
    cut = starts[(starts > 0) & (starts < len(buf))]
    first[1:] &= ~word[:-1]
    first[cut] = word[cut]
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sentence = np.searchsorted(starts, s, "right") - 1
    hashes, where = [tb.hash_spans(buf, s, e)], [sentence]
    for k in PREFIXES:
        long = e - s > k
        hashes.append(tb.hash_spans(buf, s[long], s[long] + k) ^ np.uint64(k))
        where.append(sentence[long])
    ends = np.concatenate([starts[1:], [len(buf)]]) if len(buf) else starts
    full = doc[: len(starts)] if len(buf) else np.zeros(0, np.int64)
    if not len(buf):
        starts = ends = np.zeros(0, np.int64)
    base = offs[:-1]
    doc = np.concatenate([full, empty])
    return np.concatenate(hashes), np.concatenate(where), doc, np.concatenate([starts - base[full] if len(full) else starts, np.zeros(len(empty), np.int64)]), np.concatenate([ends - base[full] if len(full) else ends, np.zeros(len(empty), np.int64)])


class Model:
    """Weights of feature hashes, in a table by their top bits, and a bias."""

    def __init__(self, texts, labels: np.ndarray):
        self.bias, self.keys, self.weights, self.prior = -12.0, np.zeros(0, np.uint64), np.zeros(0), float(labels.mean()) if len(labels) else 0.0
        if 0 < self.prior < 1:
            self._fit(texts, labels.astype(float))
        slot = (self.keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        # features that share a slot: the heaviest stays
        order = np.argsort(np.abs(self.weights), kind="stable")
        self.table = np.zeros(1 << SLOTS, np.int32)
        self.table[slot[order]] = order + 1

    def _fit(self, texts, labels: np.ndarray) -> None:
        table, bad = pa.table({"text": texts}), labels > 0

        def parts():
            """The features of a part of the rows at a time; they are computed again rather than kept."""
            at = 0
            for part in tb.pieces(table, size=tb.SLICE):
                yield features(part.column("text")), at, part.num_rows
                at += part.num_rows

        def by_document(h, where, doc) -> tuple[np.ndarray, np.ndarray]:
            """The distinct features of each document."""
            first = tb.unique(h ^ (doc[where].astype(np.uint64) << np.uint64(40)))[1]
            return h[first], doc[where[first]]

        # what enough toxic documents hold, then how many others hold it
        seen = [np.zeros(0, np.uint64)]
        for (h, where, doc, _, _), at, _ in parts():
            own = bad[doc[where] + at]
            seen.append(by_document(h[own], where[own], doc)[0])
        keys, _, index = tb.unique(np.concatenate(seen))
        toxic = np.bincount(index, minlength=len(keys))
        keys, toxic = keys[toxic >= 5], toxic[toxic >= 5]
        if not len(keys):
            return
        clean = np.zeros(len(keys))
        for (h, where, doc, _, _), at, _ in parts():
            own = np.flatnonzero(~bad[doc[where] + at])
            own = own[keys[np.searchsorted(keys, h[own]).clip(max=len(keys) - 1)] == h[own]]
            clean += np.bincount(np.searchsorted(keys, by_document(h[own], where[own], doc)[0]), minlength=len(keys))
        ratio = np.log((toxic + 0.5) / labels.sum()) - np.log((clean + 0.5) / (len(labels) - labels.sum()))
        good = np.flatnonzero(ratio > 1.6)
        good = good[np.argsort(-(ratio * np.sqrt(toxic))[good], kind="stable")][:FEATURES]
        self.keys = np.sort(keys[good])
        if not len(self.keys):
            return
        # sentences with a feature, and for each document how many have none
        rows, cols, owner, bare = [], [], [], np.zeros(len(labels))
        n = 0
        for (h, where, doc, _, _), base, size in parts():
            i = np.searchsorted(self.keys, h).clip(max=len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[i] == h)
            used, r = np.unique(where[hit], return_inverse=True)
            rows.append(r + n)
            cols.append(i[hit])
            owner.append(doc[used] + base)
            n += len(used)
            bare[base : base + size] += np.bincount(doc, minlength=size) - np.bincount(doc[used], minlength=size)
        rows, cols, owner = np.concatenate(rows), np.concatenate(cols), np.concatenate(owner)
        theta = np.concatenate([np.zeros(len(self.keys)), [-7.0]])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            z = np.bincount(rows, theta[cols], n) + theta[-1]
            p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
            total = np.bincount(owner, np.logaddexp(0, z), len(labels)) + bare * np.logaddexp(0, theta[-1])
            pull = 1 - labels / np.maximum(-np.expm1(-total), 1e-9)
            own = pull[owner] * p
            g = np.concatenate([np.bincount(cols, own[rows], len(self.keys)), [own.sum() + (pull * bare).sum() * p0]]) / len(labels)
            g[:-1] += DECAY * theta[:-1] / len(self.keys) ** 0.5
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta -= RATE * 10 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (0.3 if step > STEPS * 0.7 else 1)
            theta[:-1] = theta[:-1].clip(0)
        self.weights, self.bias = theta[:-1], float(theta[-1])

    def sentences(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start, end and score of each sentence."""
        h, where, doc, starts, ends = features(column)
        z = np.full(len(doc), self.bias)
        i = self.table[(h >> np.uint64(64 - SLOTS)).astype(np.int64)]
        hit = np.flatnonzero(i)
        hit = hit[self.keys[i[hit] - 1] == h[hit]]
        if len(hit):
            z += np.bincount(where[hit], self.weights[i[hit] - 1], len(doc))
        return doc, starts, ends, 1 / (1 + np.exp(-z))

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; start, end and score of its worst sentence."""
        n = len(column)
        doc, starts, ends, p = self.sentences(column)
        if not len(self.keys):
            p = np.zeros(len(p))
        order = np.lexsort((p, doc))
        last = np.searchsorted(doc[order], np.arange(n), "right") - 1
        worst = order[last]
        score = -np.expm1(np.bincount(doc, np.log1p(-p.clip(max=1 - 1e-12)), n))
        return score if len(self.keys) else np.full(n, self.prior), starts[worst], ends[worst], p[worst]


def judge(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        for batch in batches:
            for rows in tb.pieces(batch, size=tb.SLICE):
                score, start, end, worst = model(rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(start), pa.array(end), pa.array(worst)], names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"])

    return run


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_end long, worst_score double"


def fit(docs: DataFrame, labels: DataFrame, held_out, limit: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), but for held-out rows."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(~F.coalesce(held_out, F.lit(False)) & F.col("text").isNotNull())
    rows = shared.sample(docs, limit, labels=labels)
    return Model(rows.column("text"), np.array([x == "1" for x in rows.column("label").to_pylist()], bool))


def score(docs: DataFrame, labels: DataFrame, held_out, *, limit: int = SAMPLE) -> DataFrame:
    """Scores of docs (doc_id, text), and where the worst sentence is, in bytes of the text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out, limit))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(judge(model), SCHEMA)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out())
