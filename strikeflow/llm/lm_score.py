"""Language-model scoring with a weighted backoff automaton.

The n-grams of the training documents, smoothed by a Dirichlet prior on the
next lower order, are the arcs of an automaton whose states are contexts. A
state's failure arc leads to the context without its oldest word. Scoring reads
a text once from left to right: at each token it takes the arc of the current
state, or failure arcs down to a state that has one, and adds up the weights.

An automaton of the whole corpus has no size bound, so none is ever built.
Documents are dealt into groups of bounded text size. Each group asks for the
corpus counts of the distinct n-grams that it holds, gets them from the hash
bucket that owns each n-gram, and compiles the part of the automaton that its
texts can reach. Requests are sorted hash arrays, one for each pair of group and
bucket; the answer is a count array in the same order. No row of these shuffles
belongs to a word, so a word with a third of all tokens costs no more than
others, and what is gathered is all n-grams of all documents.

Tokens have hashes of 64 bits. Those of longer n-grams have as many bits as the
number of training tokens, and SPARE more: an n-gram shares its hash with another
with a probability of about 2**-SPARE, however large the corpus.

Results: null text scores as empty (its end token only). An empty table gives no
rows. Repeated rows are scored each. A null doc_id is never held out. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import textbytes as tb

ORDER = 3
#: Prior counts of the backoff distribution, for orders 2 and 3.
PRIOR = (100.0, 10.0)
ADD = 0.1
SPARE = 24
GROUP_BYTES = 12 << 20
BUCKET_BYTES = 6 << 20
END = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(column, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each text closed by END, and n + 1 token offsets."""
    buf, offs = tb.to_bytes(column)
    buf = tb.LOWER[buf]
    starts, ends, first = tb.spans(buf, offs)
    n = len(offs) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    counts = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    spot = np.ones(len(out), bool)
    spot[bounds[1:] - 1] = False
    out[spot] = tb.hash_spans(buf, starts, ends)
    return out, bounds


def gather(table, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    found = [tokens(part.column(name)) for part in tb.pieces(table, name)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in found]))])
    return np.concatenate([t for t, _ in found]), bounds


class Grams:
    """The distinct n-grams of one group, per order: sorted hashes, where each first ends, and the n-gram that ends at each token."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, order: int, bits: int = 64):
        place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
        self.at, self.keys, self.first, self.index = [], [], [], []
        h = ids
        for k in range(1, order + 1):
            if k > 1:
                # the k-gram that ends at t: the (k-1)-gram that ends at t-1, then t
                h = np.concatenate([h[:1], tb.chain(h[:-1], ids[1:])]) + np.uint64(k)
            at = np.flatnonzero(place >= k - 1)
            keys, first, inverse = tb.unique(h[at] >> np.uint64(64 - bits) if k > 1 else h[at])
            index = np.full(len(ids), -1, np.int32)
            index[at] = inverse
            self.at.append(at)
            self.keys.append(keys)
            self.first.append(at[first] if len(at) else at)
            self.index.append(index)


def bucket_of(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Ordered hashes in, bucket numbers in order out."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Differences, byte planes apart, so that the zero high bytes vanish."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def ask(buckets: int, order: int, bits: int):
    """Rows (bucket, grp, n, keys, counts): the distinct n-grams of a group with their counts in its training documents."""
    schema = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(key, table):
        ids, bounds = gather(table)
        train = ~np.repeat(table.column("held_out").to_numpy(), np.diff(bounds))
        grams = Grams(ids, bounds, order, bits)
        rows = []
        for n in range(1, order + 1):
            at, keys, index = grams.at[n - 1], grams.keys[n - 1], grams.index[n - 1]
            counts = np.bincount(index[at][train[at]], minlength=len(keys)).astype(np.uint32)
            own = bucket_of(keys, buckets, bits if n > 1 else 64)
            edge = np.searchsorted(own, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)):
                i, j = edge[b], edge[b + 1]
                rows.append((b, key[0].as_py(), n, pack_sorted(keys[i:j]), pack(counts[i:j])))
        return pa.Table.from_pydict({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema)

    return run, "bucket long, grp long, n int, keys binary, counts binary"


def answer(key, table):
    """For each request of a bucket the corpus counts of its n-grams, in its order."""
    grp, order = table.column("grp").to_pylist(), table.column("n").to_pylist()
    keys, counts = table.column("keys"), table.column("counts")
    out = []
    for n in sorted(set(order)):
        own = [i for i, x in enumerate(order) if x == n]
        parts = [unpack_sorted(keys[i].as_py()) for i in own]
        _, _, inverse = tb.unique(np.concatenate(parts))
        total = np.bincount(inverse, np.concatenate([unpack(counts[i].as_py(), np.uint32) for i in own]))[inverse].astype(np.uint64)
        at = 0
        for i, part in zip(own, parts, strict=True):
            out.append((grp[i], n, key[0].as_py(), pack(total[at : at + len(part)])))
            at += len(part)
    return pa.table({"grp": pa.array([r[0] for r in out], pa.int64()), "n": pa.array([r[1] for r in out], pa.int32()), "bucket": pa.array([r[2] for r in out], pa.int64()), "totals": pa.array([r[3] for r in out], pa.binary())})


class Automaton:
    """Compiled from the n-grams of a group and their corpus counts.

    weight[k]: log10 of the smoothed probability of each (k+1)-gram's arc;
    seen[k]: whether the arc exists; fail[k]: log10 weight of the failure arc
    of the state that each (k+1)-gram names.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, kinds: int, prior=PRIOR):
        self.grams, self.weight, self.seen, self.fail = grams, [], [], []
        self.counts = counts
        p = (counts[0] + ADD) / (total + ADD * (kinds + 1))
        self.weight.append(np.log10(p))
        self.seen.append(np.ones(len(p), bool))  # the root has an arc for every word, the unknown included
        for k in range(1, len(counts)):
            at = grams.first[k]
            lower, context = grams.index[k - 1][at], counts[k - 1][grams.index[k - 1][at - 1]]
            p = (counts[k] + prior[k - 1] * p[lower]) / (context + prior[k - 1])
            self.weight.append(np.log10(p))
            self.seen.append(counts[k] > 0)
            self.fail.append(np.log10(prior[k - 1] / (counts[k - 1] + prior[k - 1])))

    def traverse(self) -> np.ndarray:
        """log10 probability of each token. All tokens move one failure arc at a time; the state before a token is the longest context that precedes it."""
        out = np.zeros(len(self.grams.index[0]))
        waiting = np.arange(len(out))
        for k in range(len(self.weight) - 1, -1, -1):
            gram = self.grams.index[k][waiting]
            arc = gram >= 0
            arc[arc] = self.seen[k][gram[arc]]
            out[waiting[arc]] += self.weight[k][gram[arc]]
            waiting, gram = waiting[~arc], gram[~arc]
            if k:
                state = waiting[gram >= 0]  # others have too short a past for a state of this length
                out[state] += self.fail[k - 1][self.grams.index[k - 1][state - 1]]
        return out


def reply(total: int, kinds: int, order: int, prior, bits: int):
    def run(key, docs, answers):
        ids, bounds = gather(docs)
        n = docs.num_rows
        grams = Grams(ids, bounds, order, bits)
        rows = sorted(zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True), key=lambda r: r[:2])
        counts = [np.concatenate([np.zeros(0, np.uint64), *(unpack(t, np.uint64) for m, _, t in rows if m == k)]).astype(np.float64) for k in range(1, order + 1)]
        known = counts[0][grams.index[0]]
        base = np.log10((known + ADD) / (total + ADD * (kinds + 1)))
        score = Automaton(grams, counts, total, kinds, prior).traverse()
        add = lambda x: np.add.reduceat(x, bounds[:-1]) if n else np.zeros(0)  # noqa: E731  each text has a token at least
        return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(add((known > 0).astype(np.int64)).astype(np.int64)), "train_tokens": pa.array(np.full(n, total)), "base_score": pa.array(add(base)), "score": pa.array(add(score))})

    return run


def vocabulary(buckets: int):
    """Rows (bucket, tokens, bytes, keys): a partition's distinct training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, size = np.zeros(0, np.uint64), 0, 0
        for batch in batches:
            for part in tb.pieces(batch):
                ids, bounds = tokens(part.column("text"))
                train = ~np.repeat(part.column("held_out").to_numpy(zero_copy_only=False), np.diff(bounds))
                size += part.column("text").nbytes
                n += int(train.sum())
                kept = np.union1d(kept, ids[train])
        own = bucket_of(kept, buckets)
        edge = np.searchsorted(own, np.arange(buckets + 1))
        rows = [(int(b), n if b == 0 else 0, size if b == 0 else 0, pack_sorted(kept[edge[b] : edge[b + 1]])) for b in range(buckets) if b == 0 or edge[b + 1] > edge[b]]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "tokens": pa.array([r[1] for r in rows], pa.int64()), "size": pa.array([r[2] for r in rows], pa.int64()), "keys": pa.array([r[3] for r in rows], pa.binary())})

    return run


def count_kinds(key, table):
    kept = np.zeros(0, np.uint64)
    for x in table.column("keys").to_pylist():
        kept = np.union1d(kept, unpack_sorted(x))
    return pa.table({"tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64()), "size": pa.array([sum(table.column("size").to_pylist())], pa.int64()), "kinds": pa.array([len(kept)], pa.int64())})


def score(docs: DataFrame, held_out, *, order: int = ORDER, prior=PRIOR, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of docs (doc_id, text) under the model of those for which the column held_out is false."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = docs.select("text", "held_out").mapInArrow(vocabulary(shuffle), "bucket long, tokens long, size long, keys binary").groupBy("bucket").applyInArrow(count_kinds, "tokens long, size long, kinds long").agg(*(F.sum(c).alias(c) for c in ("tokens", "size", "kinds"))).first()
    total, size, kinds = ((x or 0) for x in got)
    groups, buckets = max(shuffle, math.ceil(size / group_bytes)), max(shuffle, math.ceil(size / bucket_bytes))
    docs = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)))
    bits = min(64, max(40, total.bit_length() + SPARE))
    run, schema = ask(buckets, order, bits)
    asked = docs.groupBy("grp").applyInArrow(run, schema)
    answers = asked.groupBy("bucket").applyInArrow(answer, "grp long, n int, bucket long, totals binary")
    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(reply(total, kinds, order, prior, bits), SCHEMA)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out())
