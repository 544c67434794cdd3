"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's
3-word shingles. Two fingerprints link at RADIUS or fewer differing bits, and a
document's component is the smallest doc_id that links lead to.

Equal fingerprints are merged first, so copies cost one row. Of the PARTS parts
of a fingerprint, at least PARTS - RADIUS are equal in a linked pair; each choice
of so many parts is a table, and fingerprints that share a table's key meet in a
bucket. In a bucket, fingerprints are stored as bit planes, one bit of each in a
machine word; a fingerprint is compared with 64 others by one exclusive-or for
each plane, whose results are added into vertical carry-save counters, and a
block of words is given up once all its counters exceed the radius. A bucket
leaves only a spanning set of links. A bucket over BUCKET is dealt out again by
the same rule over the bits that it doesn't fix, until it is small or has no
bits left; so no bucket has to meet in one task, and no pair is lost.

Components come from rounds of taking the smallest neighbouring label, and the
label of that label, each round written to the shared checkpoint folder.

Results: a text without words (null, empty) has fingerprint zero, linked like any
other. Texts of fewer words than a shingle hash as a whole. Repeated rows share
their component; a null doc_id is kept, takes part in no minimum unless all are
null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared
from strikeflow.llm import textbytes as tb

WORDS, SEED = 3, 42
RADIUS, PARTS = 2, 4
BUCKET = 4096

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span: all spans under 32 bytes at once, the others one by one."""
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf) + 1, 8), (1, 1))
    short = np.flatnonzero(size < 32)
    at, left = starts[short].copy(), size[short].copy()
    h = np.full(len(short), np.uint64(seed) + _P5, np.uint64) + left.astype(np.uint64)
    for _ in range(3):
        some = np.flatnonzero(left >= 8)
        if not len(some):
            break
        k = words[at[some]].view(np.uint64).ravel()
        k = _rotate(k * _P2, 31) * _P1
        h[some] = _rotate(h[some] ^ k, 27) * _P1 + _P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    k = words[at[some]].view(np.uint64).ravel() & np.uint64(0xFFFFFFFF)
    h[some] = _rotate(h[some] ^ (k * _P1), 23) * _P2 + _P3
    at[some] += 4
    left[some] -= 4
    for _ in range(3):
        some = np.flatnonzero(left > 0)
        if not len(some):
            break
        h[some] = _rotate(h[some] ^ (buf[at[some]].astype(np.uint64) * _P5), 11) * _P1
        at[some] += 1
        left[some] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    out[short] = h
    long = np.flatnonzero(size >= 32)
    if len(long):
        digest, view = xxhash.xxh64_intdigest, memoryview(np.ascontiguousarray(buf))
        out[long] = [digest(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each group of hashes the bits set in over half; zero for an empty group."""
    n = len(bounds) - 1
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    half = np.diff(bounds)[full]
    step = 1 << 16
    counts = np.zeros((len(full), 64), np.int64)
    edges = np.append(bounds[full], bounds[-1])
    at = 0
    while at < len(hashes):
        to = min(len(hashes), at + step)
        bits = np.unpackbits(hashes[at:to].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, to, "left")
        cuts = np.maximum(edges[a:b], at) - at
        counts[a:b] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        at = to
    out[full] = np.packbits(2 * counts > half[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingles(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order, and the bounds of each text's."""
    buf, offs = tb.to_bytes(column)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    buf = tb.LOWER[buf]
    starts, ends, first = tb.spans(buf, offs)
    # words joined by single spaces
    size = ends - starts
    stop = np.cumsum(size + 1)
    begin = stop - size - 1
    joined = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    place = np.arange(int(size.sum()))
    skip = np.cumsum(size) - size
    joined[place + np.repeat(begin - skip, size)] = buf[place + np.repeat(starts - skip, size)]
    count = np.diff(first)
    own = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(own)])
    head = np.arange(int(bounds[-1])) + np.repeat(first[:-1] - bounds[:-1], own)
    tail = head + np.repeat(np.minimum(count, words) - 1, own)
    return xxh64_spans(joined, begin[head], (begin + size)[tail]), bounds


def fingerprints(column) -> np.ndarray:
    return majority(*shingles(column, WORDS))


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in tb.pieces(batch, size=tb.SLICE):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(rows.column("text")).view(np.int64))], names=["doc_id", "fp"])


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words; bit k of word w in row p is bit p of values[64 w + k]."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(value: int, stored: np.ndarray, order: list[int], radius: int, block: int = 64) -> np.ndarray:
    """A bit for each stored value that differs from value in radius bits at most; order: the planes to compare.

    The counters of 64 values are words, one for each binary digit, and start so that more than radius differences carry out of the last.
    """
    out = np.zeros(stored.shape[1], np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    for at in range(0, stored.shape[1], block):
        part = stored[:, at : at + block]
        counts = [np.full(part.shape[1], full if start >> b & 1 else 0, np.uint64) for b in range(digits)]
        over = np.zeros(part.shape[1], np.uint64)
        for done, p in enumerate(order):
            carry = part[p] ^ (full if value >> p & 1 else np.uint64(0))
            for b in range(digits):
                counts[b], carry = counts[b] ^ carry, counts[b] & carry
            over |= carry
            if done >= radius and (over == full).all():
                break
        else:
            out[at : at + block] = ~over
    return out


def links(values: np.ndarray, fixed: int) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct values that agree in the bits of fixed: (value, root)."""
    n = len(values)
    if n == 1:
        return []
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = [int(x) for x in values]
    if n <= 16:
        for i in range(n):
            for j in range(i):
                if (own[i] ^ own[j]).bit_count() <= RADIUS:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    else:
        stored = planes(values)
        order = [p for p in range(64) if not fixed >> p & 1]
        for i in range(1, n):
            near = within(own[i], stored[:, : (i + 63) // 64], order, RADIUS)
            for w in np.flatnonzero(near).tolist():
                bits = int(near[w])
                while bits:
                    j = w * 64 + (bits & -bits).bit_length() - 1
                    bits &= bits - 1
                    if j < i:
                        a, b = root(i), root(j)
                        parent[max(a, b)] = min(a, b)
    return [(own[i], own[root(i)]) for i in range(n) if root(i) != i]


def tables(free: list[int], radius: int, parts: int) -> list[int]:
    """Masks of free bits, one for each choice of parts - radius of its parts."""
    cuts = [free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts)]
    return [sum(1 << b for k in chosen for b in cuts[k]) for chosen in combinations(range(parts), parts - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probe_buckets(rows: DataFrame) -> DataFrame:
    """(u, v): spanning links of the buckets of rows (fp, mask, key), of at most BUCKET fingerprints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        out: list[tuple[int, int]] = []

        def close():
            if held:
                values = np.array(held, np.int64).view(np.uint64)
                out.extend(links(values, last[0]))

        for batch in batches:
            for *k, fp in zip(*(batch.column(c).to_pylist() for c in ("mask", "key", "fp")), strict=True):
                if k != last:
                    close()
                    held, last = [], k
                held.append(fp)
            if len(out) > 50_000:
                yield _pairs(out)
                out.clear()
        close()
        yield _pairs(out)

    return rows.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "u long, v long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([signed(a) for a, _ in out], pa.int64()), pa.array([signed(b) for _, b in out], pa.int64())], names=["u", "v"])


def deal(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each of rows (fp, mask) once for each of the masks that its own leads to, with the bits that the new one keeps as key."""
    led = rows.sparkSession.createDataFrame([(signed(m), signed(x)) for m, own in masks.items() for x in own], "mask long, next long")
    return rows.join(F.broadcast(led), "mask").select("fp", F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("key"))


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect what RADIUS connects, of distinct fingerprints (fp)."""
    rows = deal(prints.select("fp", F.lit(0).cast("long").alias("mask")), {0: tables(list(range(64)), RADIUS, PARTS)})
    out = None
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
        rows = rows.join(sizes, ["mask", "key"]).checkpoint()
        crowded = [r[0] & (1 << 64) - 1 for r in sizes.where(F.col("n") > bucket).select("mask").distinct().collect()]  # a few masks a level
        free = {m: [b for b in range(64) if not m >> b & 1] for m in crowded}
        last = [m for m in crowded if len(free[m]) <= 12]  # at most 4,096 values are left
        large = (F.col("n") > bucket) & ~F.col("mask").isin([signed(m) for m in last])
        found = probe_buckets(rows.where(~large))
        out = found if out is None else out.unionAll(found)
        masks = {m: [x | m for x in tables(free[m], RADIUS, PARTS)] for m in crowded if m not in last}
        if not masks:
            return out
        rows = deal(rows.where(large).select("fp", "mask"), masks)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for the nodes of edges (u, v) the least node that edges lead to. Rounds grow with the logarithm of a component's width."""
    some = edges.where("u <> v")
    both = some.select("u", "v").unionAll(some.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        # the label of the node that the label names
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        moved = step.join(jump, "low").select("node", F.least("low", "further").alias("new"), "label").checkpoint()
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def dedup(docs: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component of docs (doc_id, text)."""
    shared.checkpoint_dir(docs.sparkSession)
    prints = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fingerprint_rows, "doc_id long, fp long").checkpoint()
    kinds = prints.groupBy("fp").agg(F.min("doc_id").alias("own")).checkpoint()
    labels = components(near_links(kinds.select("fp"), bucket)).withColumnRenamed("node", "fp").checkpoint()
    met = labels.join(kinds, "fp")
    least = met.groupBy("label").agg(F.min("own").alias("least"))
    linked = met.join(least, "label").select("fp", "least")
    named = kinds.join(linked, "fp", "left").select("fp", F.coalesce("least", "own").alias("component_id")).checkpoint()
    # both sides of this join come straight from a shuffle, so that Spark can split a fingerprint that many copies share
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
