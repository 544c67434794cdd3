"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenised once, cut into pieces of at most CAPACITY tokens, and
the piece lengths are counted. The counts, CAPACITY numbers however many
documents there are, define the linear program: use the fewest configurations
(multisets of lengths that fit into a sequence) so that each length is covered
as often as it occurs. Multiplicative weights solve it: a length's weight falls
as it gets covered, and the configurations of the largest weights, found by one
knapsack dynamic program, are used next, each until it has covered one of its
lengths. This goes on until every length is covered. Rounding gives each
configuration that fills a sequence well its whole number of uses while there
are pieces for them; each piece that is left over (a few hundred configurations'
worth, whatever the number of documents) goes into the fullest configuration
of what is left, by the same dynamic program over bounded numbers. All of
this is on counts: neither time nor memory grows with the number of pieces.

The plan gives each configuration slot a run of ranks: the pieces of this length
with ranks from lo to hi go to consecutive sequences at a fixed offset. A piece
gets its rank from a counter in its partition and the sum of the counts of the
partitions before, so no length, however frequent, meets in one task.

Results: a null text counts as empty and makes one piece of the end id alone. An
empty table gives no rows. Repeated rows are packed each. Other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeflow.llm import shared
from strikeflow.llm import textbytes as tb

CAPACITY = 1024
END_ID = 2
#: How fast weights fall; the loss of value up to which configurations are used at once; the part of a sequence that rounding wants filled.
RATE, LOSS, FILLED = 1.5, 0.02, 15 / 16
#: The relative gap between the sequences and the bound at which the program counts as solved, and the finest steps that are tried for it.
GAP, FINEST = 0.01, 16
SLICE = 4 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE ids of whole texts, with the ids of a tokenizer file.

    No token crosses a single space between two other characters. A batch is cut
    there, equal units are encoded once, and their ids are gathered.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.width[i] = len(token)

    def one(self, text: bytes) -> np.ndarray:
        return np.asarray(self.bpe.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all"), np.uint32)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and n + 1 offsets."""
        buf, offs = tb.to_bytes(column)
        n = len(offs) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        space = tb.SPACE[buf]
        at = (buf == 32)
        at[1:] &= ~space[:-1]
        at[:-1] &= ~space[1:]
        at[[0, -1]] = False
        inner = offs[(offs > 0) & (offs < len(buf))]
        at[inner] = False  # a text's first and last byte
        at[inner - 1] = False
        at = np.flatnonzero(at)
        full = np.flatnonzero(np.diff(offs))
        odd = self.odd(buf, offs)
        if len(odd):
            at = at[~np.isin(np.searchsorted(offs, at, "right") - 1, odd)]
        # units start at a text's start and at each cut
        starts = np.sort(np.concatenate([offs[full], at]))
        ends = np.concatenate([starts[1:], [len(buf)]])
        doc = np.searchsorted(offs, starts, "right") - 1
        alone = np.ones(len(starts), bool)
        alone[1:-1] = (doc[1:-1] != doc[:-2]) | (doc[1:-1] != doc[2:])
        safe = np.flatnonzero(~alone)
        ids, begin, size = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(safe):
            _, first, inverse = tb.unique(tb.hash_spans(buf, starts[safe], ends[safe]))
            s, e = starts[safe[first]], ends[safe[first]]
            width = e - s
            take = np.arange(int(width.sum())) + np.repeat(s - np.cumsum(width) + width, width)
            got = self.one(buf[take].tobytes())
            edge = np.concatenate([[0], np.searchsorted(np.cumsum(self.width[got]), np.cumsum(width)) + 1])
            begin[safe], size[safe] = edge[:-1][inverse], np.diff(edge)[inverse]
            ids.append(got)
        total = sum(map(len, ids))
        raw = buf.tobytes()
        for i in np.flatnonzero(alone):
            got = self.one(raw[starts[i] : ends[i]])
            begin[i], size[i] = total, len(got)
            total += len(got)
            ids.append(got)
        pool = np.concatenate(ids)
        stop = np.cumsum(size)
        out = pool[np.arange(int(stop[-1])) + np.repeat(begin - stop + size, size)]
        return out, np.concatenate([[0], stop])[np.searchsorted(starts, offs)]

    @staticmethod
    def odd(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that hold white space beyond ASCII, and so aren't cut."""
        padded = np.concatenate([buf, np.zeros(2, np.uint8)])
        found = []
        for lead, rest in ((0xC2, (b"\x85", b"\xa0")), (0xE1, (b"\x9a\x80",)), (0xE2, (b"\x80", b"\x81\x9f")), (0xE3, (b"\x80\x80",))):
            at = np.flatnonzero(buf == lead)
            for tail in rest:
                found.append(at[np.logical_and.reduce([padded[at + 1 + k] == x for k, x in enumerate(tail)])])
        return np.unique(np.searchsorted(offs, np.concatenate(found), "right") - 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def cut_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in tb.pieces(batch, size=SLICE):
                ids, bounds = encode(rows.column("text"))
                data = ids.astype("<u4").tobytes()
                end = np.array([end_id], "<u4").tobytes()
                out: list[tuple] = []
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for k, (s, e) in enumerate(shared.cuts(b - a + 1, capacity)):
                        own = data[4 * (a + s) : 4 * min(a + e, b)] + (end if a + e > b else b"")
                        out.append((doc, k, s, e - s, zlib.crc32(own), part, int(seen[e - s])))
                        seen[e - s] += 1
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


Config = tuple[tuple[int, int], ...]


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """value: what a piece of each length from 0 on is worth (less than 0: there is none). The largest sum of values in each capacity, and the longest piece of that choice (0: a place stays free)."""
    capacity = len(value) - 1
    back = value[::-1].copy()
    best, piece = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        sums = back[capacity - c : capacity] + best[:c]
        i = int(sums.argmax())
        if sums[i] > best[c - 1]:
            best[c], piece[c] = sums[i], c - i
        else:
            best[c] = best[c - 1]
    return best, piece


def chosen(length: int, piece: np.ndarray) -> Counter:
    """A piece of this length and the best choice for the rest of the capacity."""
    own, c = Counter([length]), len(piece) - 1 - length
    while c > 0:
        if x := int(piece[c]):
            own[x] += 1
        c -= x or 1
    return own


def fractional(histogram: dict[int, int], capacity: int, parts: int = 1) -> tuple[dict[Config, float], float]:
    """Configurations ((length, times), ...) and how often to use each, so that all lengths are covered exactly; and a lower bound of the uses, from the weights as a dual solution. A step covers no more than 1 / parts of a length."""
    count = np.zeros(capacity + 1)
    count[list(histogram)] = list(histogram.values())
    lengths, some = np.arange(capacity + 1), count > 0
    covered, use, bound = np.where(some, 0.0, 1.0), Counter(), 0.0
    while (open_ := covered < 1 - 1e-9).any():
        weight = np.where(open_, lengths / capacity * np.exp(RATE * (covered[open_].min() - covered)), -1.0)
        best, piece = knapsack(weight)
        bound = max(bound, float((weight * count)[open_].sum() / best[capacity]))
        total = np.where(open_, weight + best[capacity - lengths], -1.0)
        used = np.zeros(capacity + 1, bool)
        # one dynamic program prices the best configuration with each length; those without a length in common don't wait for new weights
        for x in np.argsort(-total, kind="stable").tolist():
            if total[x] < (1 - LOSS) * best[capacity]:
                break
            if used[x]:
                continue
            config = chosen(x, piece)
            index, times = np.array(list(config)), np.array(list(config.values()))
            if used[index].any():
                continue
            step = float((np.minimum(1 - covered[index], 1 / parts) * count[index] / times).min())
            use[tuple(sorted(config.items()))] += step
            covered[index] += step * times / count[index]
            used[index] = True
    return dict(use), bound


def fullest(left: Counter, room: int, lengths: list[int]) -> Counter:
    """The choice of what is left with the largest sum that fits into room, long pieces first. lengths: those of left, ascending. Sets of sums are the bits of an integer."""
    reach, mask, before = 1, (1 << room + 1) - 1, []
    for x in lengths:
        if x > room or reach >> room & 1:
            break
        before.append((x, reach))
        n, some = min(left[x], room // x), 1
        while n > 0:
            reach |= reach << x * min(some, n) & mask
            n, some = n - some, 2 * some
    own, c = Counter(), reach.bit_length() - 1
    for x, others in reversed(before):
        n = min(left[x], c // x)
        while n and not others >> c - n * x & 1:
            n -= 1
        if n:
            own[x] = n
            c -= n * x
    return own


def rounded(histogram: dict[int, int], use: dict[Config, float], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations and whole numbers of uses that place each piece once; and how many of them come from use."""
    left, out = Counter(histogram), []
    for config, times in sorted(use.items(), key=lambda x: (-x[1], x[0])):
        n = min(math.ceil(times - 1e-6), min(left[x] // k for x, k in config))
        if n and sum(x * k for x, k in config) >= FILLED * capacity:
            out.append((dict(config), n))
            left.subtract({x: n * k for x, k in config})
    own = len(out)
    while lengths := sorted(x for x in left if left[x]):
        lead = lengths[-1]
        left[lead] -= 1
        config = fullest(left, capacity - lead, lengths)
        left[lead] += 1
        config[lead] += 1
        n = min(left[x] // k for x, k in config.items())
        out.append((dict(config), n))
        left.subtract({x: n * k for x, k in config.items()})
    return out, own


def solved(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """Configurations with whole numbers of uses, how many of them come from the program, and the lower bound: with finer steps until the sequences are within GAP of the bound, or steps are 1 / FINEST."""
    best, least, parts = None, 0.0, 1
    while True:
        use, bound = fractional(histogram, capacity, parts)
        configs, own = rounded(histogram, use, capacity)
        n, least = sum(k for _, k in configs), max(least, bound, sum(x * k for x, k in histogram.items()) / capacity)
        best = min(best or (n, configs, own), (n, configs, own), key=lambda x: x[0])
        if best[0] <= math.ceil(least - 1e-6) + GAP * least or parts >= FINEST:
            return best[1], best[2], least
        parts *= 2


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, lo, sequence, offset): pieces of this length with ranks from lo on go to sequences from this on, at this offset."""
    configs = solved({x: n for x, n in histogram.items() if x < capacity}, capacity)[0]
    if capacity in histogram:
        configs.append(({capacity: 1}, histogram[capacity]))
    runs, taken, sequence = [], Counter(), 0
    for config, times in configs:
        at = 0
        for x in sorted(config, reverse=True):
            for _ in range(config[x]):
                runs.append((x, taken[x], sequence, at))
                taken[x] += times
                at += x
        sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def place(runs: np.ndarray):
    """Turns rank into sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(runs[i, 2] + rank - runs[i, 1]), pa.array(runs[i, 3])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) and their places in sequences of at most capacity tokens."""
    spark = docs.sparkSession
    shared.checkpoint_dir(spark)
    cuts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = cuts.mapInArrow(cut_pieces(path or vocabulary(), capacity, end_id), PIECES).checkpoint()
    # rows of this: partitions x lengths at most
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
