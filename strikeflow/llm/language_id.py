"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to DEPTH long. A node holds how
often each byte followed its context; escape method C with exclusion gives a
byte that the node hasn't seen its share of the parent's distribution, down to the uniform one over all 256 bytes. The
statistics are frozen after training, so each node's distribution sums to one, and a text's exact code length is a
sum of table entries. The language with the shortest code wins.

A tree is stored sparsely: the code lengths of the bytes that each node has seen, and what an
escape from the node costs, so a model's size is in proportion to the distinct sequences of its training
text, for each language alone. Sequences that any language has seen at full depth (the commonest ones, KEPT numbers in all) have one row with the code lengths of all
languages; others are looked up from node to node.

ASCII is lower-cased; texts are taken to follow DEPTH line feeds.
Training takes about SAMPLE labelled rows of about MAX_BYTES (see shared.sample), an even share for each language, so that rare languages
are learned too: the most frequent ones (shared.CLASSES) if there are more, and none that has empty texts only. Texts over a sixteenth of MAX_BYTES aren't learned from. Results: `und`
and score 0 for a null text, one without a letter, or when there is nothing to
learn from. Ties go to the first language in order. Repeated rows are predicted
each; other columns are ignored. A null doc_id isn't held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared
from strikeflow.llm import textbytes as tb

DEPTH = 3
SAMPLE, MAX_BYTES = 3000, 12 << 20
START = 10
SLOTS = 22
#: The most code lengths (of sequences, by language) that are kept.
KEPT = 1 << 24
LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def sequences(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte a number of the DEPTH bytes before it and itself, itself in the lowest 8 bits."""
    n = len(offs) - 1
    padded = np.full(len(buf) + DEPTH * n, START, np.uint32)
    at = np.arange(len(buf)) + np.repeat(DEPTH * np.arange(1, n + 1), np.diff(offs))
    padded[at] = tb.LOWER[buf]
    code = np.zeros(len(buf), np.uint32)
    for k in range(DEPTH, -1, -1):
        code = code << np.uint32(8) | padded[at - k]
    return code


def found(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of sought would stand in sorted keys, and whether it does."""
    i = np.searchsorted(keys, sought).clip(max=max(0, len(keys) - 1))
    return i, keys[i] == sought if len(keys) else np.zeros(len(sought), bool)


class Tree:
    """seen[d]: sorted sequences of a context of d bytes and a byte, with the byte's probability; nodes[d]: contexts of d bytes, and the factor by which an escape scales the parent's probabilities."""

    def __init__(self, codes: np.ndarray):
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        full, times = np.unique(codes, return_counts=True)
        for d in range(DEPTH + 1):
            keys, index = np.unique(full & np.uint32((1 << 8 * (d + 1)) - 1), return_inverse=True)
            counts = np.bincount(index, times, len(keys))
            context, node = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(node, counts), np.bincount(node)
            unseen = 1 - np.bincount(node, self.probability(d - 1, keys & np.uint32((1 << 8 * d) - 1)))
            open_ = (kinds < 256) & (unseen > 1e-12)
            scale = np.where(open_, kinds / (total + kinds) / np.where(open_, unseen, 1), 0)
            self.seen.append((keys, counts / (total + np.where(open_, kinds, 0))[node]))
            self.nodes.append((context, scale))

    def probability(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """Of the last byte of each of keys after the depth bytes before it."""
        if depth < 0:
            return np.full(len(keys), 1 / 256)
        i, hit = found(self.seen[depth][0], keys)
        out = np.empty(len(keys))
        out[hit] = self.seen[depth][1][i[hit]]
        other = keys[~hit]
        if len(other):
            k, known = found(self.nodes[depth][0], other >> np.uint32(8))
            out[~hit] = self.probability(depth - 1, other & np.uint32((1 << 8 * depth) - 1)) * np.where(known, self.nodes[depth][1][k], 1)
        return out


class Model:
    """A tree for each language; bits[i]: the code lengths, by language, of the last byte of sequence keys[i]; slot: where to look for a sequence."""

    def __init__(self, texts: pa.ChunkedArray, labels: list[str]):
        self.languages = sorted(set(labels))
        buf, offs = tb.to_bytes(texts)
        codes = sequences(buf, offs)
        owner = np.repeat(np.searchsorted(self.languages, labels), np.diff(offs))
        self.trees = [Tree(codes[owner == k]) for k in range(len(self.languages))]
        keys, times = np.unique(codes, return_counts=True)
        # of many languages the commonest sequences only; the code lengths of others are computed where they occur
        often = np.argsort(-times, kind="stable")[: max(1, KEPT // len(self.trees))]
        self.keys = np.sort(keys[often])
        self.bits = np.stack([self.lengths(k, self.keys).astype(np.float32) for k in range(len(self.trees))], 1)
        self.slot: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"slot": None}

    def lengths(self, language: int, keys: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -np.log2(self.trees[language].probability(DEPTH, keys))

    def code_lengths(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits by text and language; bytes; whether the text has an ASCII letter."""
        place = lambda codes: (codes * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)
        if self.slot is None:
            self.slot = np.zeros(1 << SLOTS, np.int32)
            self.slot[place(self.keys)] = np.arange(len(self.keys))
        buf, offs = tb.to_bytes(column)
        total = np.zeros((len(offs) - 1, len(self.languages)))
        letter = np.zeros(len(offs) - 1, bool)
        if len(buf):
            codes = sequences(buf, offs)
            full = np.flatnonzero(np.diff(offs))
            index = self.slot[place(codes)]
            miss = np.flatnonzero(self.keys[index] != codes)
            rare, where = np.unique(codes[miss], return_inverse=True)
            for k in range(len(self.languages)):
                bits = self.bits[:, k][index]
                bits[miss] = self.lengths(k, rare)[where]
                total[full, k] = np.add.reduceat(bits, offs[full], dtype=np.float64)
            letter[full] = np.logical_or.reduceat(_ASCII_LETTER[tb.LOWER[buf]], offs[full])
        return total, np.diff(offs), letter


def predict(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        for batch in batches:
            for rows in tb.pieces(batch, size=tb.SLICE):
                bits, size, letter = model.code_lengths(rows.column("text"))
                for i in np.flatnonzero(~letter):
                    letter[i] = bool(LETTER.search(rows.column("text")[int(i)].as_py() or ""))
                best = bits.argmin(1)
                with np.errstate(under="ignore"):
                    gap = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(size, 1))[:, None]
                    score = np.where(letter, 1 / np.exp2(-gap).sum(1), 0.0)
                found = [model.languages[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(found, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, held_out, *, limit: int = SAMPLE) -> DataFrame:
    """Languages of docs (doc_id, text, lang), learned from rows that aren't held out."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string").alias("label"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = shared.sample(docs.where("not held_out and text <> ''"), limit, MAX_BYTES, stratified=True)
    every = docs.select("doc_id", "text", "held_out")
    if not rows.num_rows:
        return every.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(Model(rows.column("text"), rows.column("label").to_pylist()))
    return every.mapInArrow(predict(model), SCHEMA)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
