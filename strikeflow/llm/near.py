"""SimHash near-duplicates at a similarity: the form of the operator that stages use.

Two texts link if the Jaccard similarity of their sets of WORDS-word shingles is
SIMILAR[0] / SIMILAR[1] or more and their fingerprints differ in RADIUS bits at
most, which holds for all but about one in 10,000 pairs at this similarity, and fewer above it.
Components are what links connect. No other link is lost: in any common order of shingles, two such sets share one of the
first size - ceil(size * similarity) + 1 of either (prefix filter), so sets that
share such a key meet in a bucket, where their fingerprints are compared, in large buckets bit-sliced
(see simhash), and pairs within the radius are verified on whole sets. Before that, pairs of a large bucket are held
against the sets' parities: a set's shingles are counted modulo two in bins, SPARSE bins a shingle, and two sets differ in
at least as many shingles as their parities differ in bins. So this filter loses no pair, and of the sets of a template that
are alike, but not similar, hardly a pair is left to verify.
The order is by hash, but shingles that are frequent come last, so that a passage in many texts
makes few candidates.

Equal sets are merged first. A bucket of up to FEW sets leaves all its pairs, a larger
one first a few links from each set, which connect most of a group
of copies; later, all pairs that aren't yet connected. Frequent keys are dealt out twice into buckets
of a bounded size for the former, and into pairs of such buckets for the latter, so that no
group of copies has to meet in one task.

Results: a row for each row. A text of fewer words than a shingle is one
shingle; texts without words equal each other. Repeated rows and rows without
doc_id are compared like any other. Hashes of 64 bits stand for shingles, sets and texts.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm import shared, simhash
from strikeflow.llm import textbytes as tb

WORDS = 5
SIMILAR = (4, 5)
RADIUS = 20
#: Sets of a bucket up to which all pairs are taken at once, rows of a block of distances, and sets from which on they are stored as bit planes.
FEW, BLOCK, PLANES = 16, 256, 1024
#: Bins of a set's parities for each of its shingles, rounded up to a power of two, and the fewest and most of a set.
SPARSE, BINS = 2.5, (512, 1 << 14)
#: Keys of more than HOT sets come last in the order, the MOST most frequent at most; any choice gives the same links.
HOT, MOST = 64, 1 << 16


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within a text, and the bounds of each text's."""
    hashes, bounds = simhash.shingles(column, WORDS)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(bounds)))


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    view, at = memoryview(np.ascontiguousarray(hashes)).cast("B"), (bounds * 8).tolist()
    return np.array([xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def parities(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set a bit for each bin, 1 if an odd number of its shingles is in it."""
    size = np.diff(bounds)
    n = np.clip(1 << np.ceil(np.log2(np.maximum(SPARSE * size, 1))).astype(np.int64), *BINS)
    begin = np.cumsum(n) - n
    at = np.repeat(begin, size) + (hashes & np.repeat(n - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(n.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[b // 8 : (b + k) // 8] for b, k in zip(begin.tolist(), n.tolist(), strict=True)]


class Parities:
    """Those of the sets of a bucket, which can be halved in length to meet those of smaller sets."""

    def __init__(self, odd: list[bytes], size: np.ndarray):
        self.size, self.length = size, np.array([len(x) // 8 for x in odd])
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            own = np.zeros((len(odd), n), np.uint64)
            for k in np.unique(self.length[self.length >= n]).tolist():
                which = np.flatnonzero(self.length == k)
                whole = np.frombuffer(b"".join([odd[i] for i in which]), np.uint64).reshape(len(which), k // n, n)
                own[which] = np.bitwise_xor.reduce(whole, axis=1)
            self.rows[n] = own

    def may_be_similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets i and j differ in few enough bins to be similar."""
        top, of = SIMILAR
        out = np.zeros(len(i), bool)
        length = np.minimum(self.length[i], self.length[j])
        for n, rows in self.rows.items():
            at = np.flatnonzero(length == n)
            for k in range(0, len(at), 1 << 14):
                a, b = i[at[k : k + (1 << 14)]], j[at[k : k + (1 << 14)]]
                apart = np.bitwise_count(rows[a] ^ rows[b]).sum(1, dtype=np.int64)
                # at this similarity sets of sizes s and t differ in (s + t) * (of - top) / (of + top) shingles at most
                out[at[k : k + (1 << 14)]] = apart * (of + top) <= (of - top) * (self.size[a] + self.size[b])
        return out


def prefix(hashes: np.ndarray, bounds: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix keys of sets, the set of each, and whether it is one of late (sorted), which come last."""
    top, of = SIMILAR
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    last = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes if len(late) else np.zeros(len(hashes), bool)
    if last.any():
        order = np.lexsort((hashes, last, owner))
        hashes, last = hashes[order], last[order]
    n = np.where(size > 0, size - (top * size + of - 1) // of + 1, 0)
    keep = np.arange(len(hashes)) - bounds[:-1][owner] < n[owner]
    return hashes[keep], owner[keep], last[keep]


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): keys that a partition's distinct sets have in common, of those that come first by hash."""
    seen, found = set(), [np.zeros(0, np.uint64)]
    for batch in batches:
        for rows in tb.pieces(batch, size=tb.SLICE):
            hashes, bounds = shingle_sets(rows.column("text"))
            keys, owner, _ = prefix(hashes, bounds, np.zeros(0, np.uint64))
            new = unseen(digests(hashes, bounds), seen)
            found.append(keys[new[owner]])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 2].view(np.int64)), pa.array(counts[counts > 2])], names=["key", "n"])


def unseen(nodes: np.ndarray, seen: set) -> np.ndarray:
    """Which nodes are the first of their kind in a partition."""
    out = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


ROWS = "doc_id long, text_key long, node long, fp long, size long, keys array<long>, late array<long>, odd binary"


def set_rows(late: np.ndarray, spark):
    """Hashes of each text and of its set, the set's fingerprint and size, and for the first of equal sets in a partition its prefix and parities."""
    sent = spark.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for rows in tb.pieces(batch, size=tb.SLICE):
                hashes, bounds = shingle_sets(rows.column("text"))
                node, n = digests(hashes, bounds), rows.num_rows
                keys, owner, last = prefix(hashes, bounds, sent.value)
                first = unseen(node, seen)
                new = first[owner]
                own = [lists(keys[m], np.bincount(owner[m], minlength=n)) for m in (new & ~last, new & last)]
                own.append(pa.array([x if f else None for x, f in zip(parities(hashes, bounds), first.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(node), pa.array(simhash.majority(hashes, bounds).view(np.int64)), pa.array(np.diff(bounds)), *own], names=["doc_id", "text_key", "node", "fp", "size", "keys", "late", "odd"])

    return run


def whole_sets(wanted: np.ndarray, spark):
    """The distinct sets of a partition whose node may be one of a bitmap's."""
    sent = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for rows in tb.pieces(batch, size=tb.SLICE):
                hashes, bounds = shingle_sets(rows.column("text"))
                node, size = digests(hashes, bounds), np.diff(bounds)
                new = shared.may_hold(sent.value, node)
                new[new] = unseen(node[new], seen)
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), lists(hashes[np.repeat(new, size)], size[new])], names=["node", "items"])

    return run


def sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    top, of = SIMILAR
    return of * np.minimum(a, b) >= top * np.maximum(a, b)


def nearest(node: np.ndarray, fp: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a large bucket, few links that connect most of it: each set with its nearest one, and with the one that is nearest to all."""
    n = len(node)
    every, best, away, total = np.arange(n), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    for at in range(0, n, BLOCK):
        own = every[at : at + BLOCK]
        d = np.bitwise_count(fp[own, None] ^ fp[None]).astype(np.int16)
        total[own] = np.minimum(d, 2 * RADIUS).sum(1)
        d[~sized(size[own, None], size[None])] = 65
        d[own - at, own] = 65
        best[own] = d.argmin(1)
        away[own] = d[own - at, best[own]]
    middle = int(total.argmin())
    near = np.flatnonzero(away <= RADIUS)
    star = np.flatnonzero((np.bitwise_count(fp ^ fp[middle]) <= RADIUS) & sized(size, size[middle]) & (every != middle))
    return [(node[near], node[best[near]]), (node[star], np.full(len(star), node[middle]))]


def bucket_pairs(node: np.ndarray, fp: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray, odd: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a large bucket, all pairs within the radius, and of parities near enough, that differ in label. Sets of the same side other than 2 aren't paired.

    Sets of the most frequent label needn't be compared with each other, so only the others are held against the bit planes.
    """
    out = []
    kinds, index, counts = np.unique(label, return_inverse=True, return_counts=True)
    last = index == counts.argmax()
    order = np.argsort(last, kind="stable")  # the most frequent label comes last
    node, fp, size, label, side, odd = (x[order] for x in (node, fp, size, label, side, odd))
    told = Parities(odd.tolist(), size)
    queries = len(fp) - int(last.sum())

    def put(i: np.ndarray, j: np.ndarray) -> None:
        ok = sized(size[j], size[i]) & (label[j] != label[i]) & ((side[j] != side[i]) | (side[i] == 2))
        if ok.any():
            i, j = i[ok], j[ok]
            ok = told.may_be_similar(i, j)
            out.append((node[j[ok]], node[i[ok]]))

    if len(fp) <= PLANES:  # too few for bit planes to pay
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:queries, None] ^ fp[None]) <= RADIUS, 1))
        put(i, j)
        return out
    stored, every = simhash.planes(fp), list(range(64))
    for i in range(queries):
        near = simhash.within(int(fp[i]), stored[:, i // 64 :], every, RADIUS)
        j = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")) + i // 64 * 64
        j = j[(j > i) & (j < len(fp))]
        put(np.full(len(j), i), j)
    return out


def compared(rows: DataFrame, labelled: bool) -> DataFrame:
    """(u, v) of the buckets of rows (key, part, node, fp, size; labelled, also label, side, odd); without labels, also (key, null) for a bucket of more than FEW sets."""
    names = ["key", "part", "node", "fp", "size", *(["label", "side", "odd"] if labelled else [])]

    def told(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate([[0], (cols["key"][1:] != cols["key"][:-1]) | (cols["part"][1:] != cols["part"][:-1])]))
        # a set that several partitions hold counts once
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (cols["node"][1:] != cols["node"][:-1])])
        group, cols = group[new], {k: v[new] for k, v in cols.items()}
        node, fp, size = cols["node"], cols["fp"].view(np.uint64), cols["size"]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        n = np.diff(np.append(start, len(group)))
        little = np.repeat(n, n) <= FEW
        pairs = []
        for d in range(1, FEW):
            i = np.flatnonzero((group[:-d] == group[d:]) & little[:-d]) if d < len(group) else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + d
            ok = (np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS) & sized(size[i], size[j])
            if labelled:
                ok &= (cols["label"][i] != cols["label"][j]) & ((cols["side"][i] != cols["side"][j]) | (cols["side"][i] == 2))
            pairs.append((node[i[ok]], node[j[ok]]))
        large = np.flatnonzero(n > FEW)
        for k in large.tolist():
            at = slice(start[k], start[k] + n[k])
            pairs += bucket_pairs(node[at], fp[at], size[at], *(cols[c][at] for c in ("label", "side", "odd"))) if labelled else nearest(node[at], fp[at], size[at])
        u, v = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
        # the same pair meets under many keys
        u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1) if len(u) else (u, v)
        many = np.zeros(0, np.int64) if labelled else cols["key"][start[large]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, many])), pa.array(np.concatenate([v, np.zeros(len(many), np.int64)]), mask=np.arange(len(u) + len(many)) >= len(u))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [] for c in names}
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            # a bucket may go on in the next batch
            other = np.flatnonzero((new["key"] != new["key"][-1]) | (new["part"] != new["part"][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            same = rows and held["key"][-1][-1] == new["key"][0] and held["part"][-1][-1] == new["part"][0]
            if cut or (rows and not same):
                for c in names:
                    held[c].append(new[c][:cut])
                rows += cut
                if rows:
                    yield from told({c: np.concatenate(x) for c, x in held.items()})
                held, rows = {c: [] for c in names}, 0
            for c in names:
                held[c].append(new[c][cut:])
            rows += len(new["key"]) - cut
        if rows:
            yield from told({c: np.concatenate(x) for c, x in held.items()})

    by = ["key", "part"]
    return rows.select(*names).repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar."""
    top, of = SIMILAR
    side = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"items_{name}"))
    common = F.size(F.array_intersect("items_u", "items_v"))
    return pairs.hint("merge").join(side("u"), "u").hint("merge").join(side("v"), "v").where((top + of) * common >= top * (F.size("items_u") + F.size("items_v"))).select("u", "v")


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, items): the whole sets of the ends of pairs."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().checkpoint()
    sets = docs.mapInArrow(whole_sets(shared.bitmap(ends), docs.sparkSession), "node long, items array<long>")
    return shared.written(sets.join(shared.small(ends), "node", "left_semi").groupBy("node").agg(F.any_value("items").alias("items")))


def keys_of(rows: DataFrame, some: DataFrame) -> DataFrame:
    """(node, fp, size, key): the prefix keys of rows that are some (key, a checkpoint)."""
    sent = rows.sparkSession.sparkContext.broadcast(shared.bitmap(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("keys")
            at = own.value_parent_indices()
            keys = own.flatten()
            take = shared.may_hold(sent.value, keys.to_numpy(zero_copy_only=False))
            of = at.filter(pa.array(take))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("node", "fp", "size")), keys.filter(pa.array(take))], names=["node", "fp", "size", "key"])

    found = rows.where("keys is not null").select("node", "fp", "size", "keys").mapInArrow(run, "node long, fp long, size long, key long")
    return found.join(shared.small(some), "key", "left_semi").select("node", "fp", "size", "key")


def components(docs: DataFrame, *, hot: int = HOT, bucket: int = simhash.BUCKET) -> DataFrame:
    """(doc_id, text_key, component) of docs (doc_id, text): equal components are near-duplicates."""
    spark = docs.sparkSession
    shared.checkpoint_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    often = docs.mapInArrow(frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot).withColumn("digits", F.length(F.bin("n"))).checkpoint()
    least, left = 64, MOST
    for r in often.groupBy("digits").agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect():  # 64 rows at most
        left -= r["n"]
        least = r["digits"] if left >= 0 else least
    often = often.where(F.col("digits") >= least).select("key").toArrow()
    late = np.sort(often.column("key").to_numpy().astype(np.int64).view(np.uint64))
    rows = shared.written(docs.mapInArrow(set_rows(late, spark), ROWS))
    keyed = rows.select("node", "fp", "size", F.explode("keys").alias("key"), F.lit(0).cast("long").alias("part"))
    # frequent keys that are in a prefix even so: MOST at most
    crowd = rows.select("node", "fp", "size", F.explode("late").alias("key")).distinct()
    parts = F.ceil(F.col("n") / bucket).cast("long")
    counts = crowd.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", parts.alias("parts"))
    crowd = crowd.join(F.broadcast(counts), "key").checkpoint()
    chunk = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts"))
    # two ways to deal a key out connect its buckets with each other
    twice = crowd.select("node", "fp", "size", "key", F.explode(F.when(F.col("parts") > 1, F.array(chunk(0), chunk(1) + F.col("parts"))).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    met = compared(keyed.unionByName(twice), False).distinct().checkpoint()
    pairs, large = met.where("v is not null"), met.where("v is null").select(F.col("u").alias("key"))
    edges = verified(pairs, sets_of(docs, pairs)).checkpoint()
    if large.limit(1).count():
        labels = shared.small(simhash.components(edges).checkpoint())
        again = crowd.select("node", "fp", "size", "key", "parts").unionByName(keys_of(rows, large).withColumn("parts", F.lit(1).cast("long")).distinct())
        again = again.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).checkpoint()
        mixed = again.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first < last").select("key").checkpoint()
        odd = rows.where("odd is not null").groupBy("node").agg(F.any_value("odd").alias("odd"))
        again = again.join(shared.small(mixed), "key", "left_semi").join(odd, "node")
        # part (a, b) of a key holds its chunks a and b, as sides 0 and 1; part (a, a) chunk a alone, as side 2
        own = chunk(0)
        places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct((F.least(own, x) * F.col("parts") + F.greatest(own, x)).alias("part"), F.when(x == own, 2).otherwise((own > x).cast("int")).cast("long").alias("side")))
        more = compared(again.select("node", "fp", "size", "key", "label", "odd", F.explode(places).alias("p")).select("node", "fp", "size", "key", "label", "odd", "p.part", "p.side"), True).distinct()
        more = more.join(pairs, ["u", "v"], "left_anti").checkpoint()
        edges = edges.unionAll(verified(more, sets_of(docs, more)).checkpoint())
    labels = simhash.components(edges)
    # if shuffled, both sides of this join come straight from there, so that Spark can split a set that many copies share
    return rows.select("doc_id", "text_key", "node").join(shared.small(labels.checkpoint()), "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("component"))
