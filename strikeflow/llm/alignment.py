"""Alignment of two tokenizers by the places at which both end a token.

Each byte of a text has a label: no token ends there, one of tokenizer A, one of B,
or both. A regular expression scans the labels for spans up to each both-label; a span is a
group, and its labels tell how many tokens of A and of B it has and which of them overlap.

Tokenizers and scan work on units: no token of either crosses a single space between
characters that aren't white space, so texts are cut there, and equal units of a batch
are solved once, together (they are compared by their bytes).

The number of documents that hold a pair of ids linked is a count over the whole corpus.
Batches of documents (GROUP bytes of text, or one longer document) are written as a row
each, with the distinct pairs of the batch and for each document the numbers of its pairs. The pairs
are counted from these rows, and each batch asks for the counts of its own pairs once: one row for
a batch and pair, however often it occurs, and none for a document and pair. So what is shuffled
is a part of the input, a pair that all texts hold has a row for each batch, and nothing is sent to the driver. The best counts
have a row for each id of A at most and are broadcast.

Results: one row for each row of docs. A null or empty text, and one whose bytes
aren't those of its tokens (B turns a marker into a space), has no tokens: zeros, and ''. Special tokens in
a text are plain text. Repeated rows are documents of their own. Texts of any length are
taken whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import packing, pieces, shared
from strikeflow.llm import textbytes as tb

#: Bytes of text in a batch, and of a row group of batches.
GROUP, ROW_GROUP = 2 << 20, 4 << 20
MARK = "▁"
#: A pair of ids as one number: the id of A times this, plus that of B.
PAIR = 1 << 24

#: Labels of bytes: no token ends here, one of A, one of B, both.
NONE, A_END, B_END, BOTH = b"0123"
SPAN = re.compile(rb"[^3]*3")


class Units(NamedTuple):
    """What is known of distinct units, in an order of their own: rank of each as given; whether its bytes are those of its tokens (else there is nothing of it); tokens, groups and links of each; the links' pairs, one unit's after another's; the groups as text, each with ; behind."""

    rank: np.ndarray
    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    texts: list[bytes]


def labels(size: int, a_width: np.ndarray, b_width: np.ndarray) -> bytes:
    """The label of each of size bytes that tokens of these widths cover."""
    out = np.full(size, NONE, np.uint8)
    out[np.cumsum(a_width) - 1] += A_END - NONE
    out[np.cumsum(b_width) - 1] += B_END - NONE
    return out.tobytes()


def group_ends(told: bytes) -> np.ndarray:
    """Where each span of labels up to a both-label ends."""
    return np.fromiter((span.end() for span in SPAN.finditer(told)), np.int64)


def group_texts(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """a1,a2|b1; and so on for groups of so many ids of a and of b each, and where each id's text begins (in order; one more value for the end)."""
    before_a, before_b = np.cumsum(in_a), np.cumsum(in_b)
    at_a = np.arange(len(a)) + np.repeat(before_b - in_b, in_a)
    at_b = np.arange(len(b)) + np.repeat(before_a, in_b)
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    sign[at_a[before_a - 1]], sign[at_b[before_b - 1]] = ord("|"), ord(";")
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 8))
    edge = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(edge[-1], np.uint8)
    out[edge[1:] - 1] = sign
    for k in range(int(digits.max(initial=0))):
        has = np.flatnonzero(digits > k)
        out[edge[1:][has] - 2 - k] = ord("0") + ids[has] // 10**k % 10
    return out.tobytes(), edge


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = packing.encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        one = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
        found = [one(i) for i in range(self.b.get_piece_size())]
        # a cut in front of a space is safe if no piece holds one behind another character
        if any(b" " in x.lstrip(b" ") for x in found):
            raise ValueError("pieces of B cross spaces")
        self.b_width = np.array([len(x) for x in found])
        self.b_pool = np.frombuffer(b"".join(found), np.uint8)

    def encode_a(self, units: list[bytes], plain: int) -> np.ndarray:
        """Ids of units, of which so many at the front have no white space at their ends but the first byte: no token crosses into the next of these."""
        joined = self.a.bpe.encode_to_numpy(b"".join(units[:plain]).decode(), allowed_special=set(), disallowed_special=())
        return np.concatenate([joined.astype(np.int64), *(np.array(self.a.bpe.encode_ordinary(u.decode()), np.int64) for u in units[plain:])])

    def solve(self, found: list[bytes]) -> Units:
        """Distinct units, each of which begins with a space."""
        size = np.array([len(u) for u in found], np.int64)
        buf = np.frombuffer(b"".join(found), np.uint8)
        white = tb.SPACE[buf] | wide_space(buf)
        ends = np.cumsum(size)
        plain = (size > 1) & ~white[np.minimum(ends - size + 1, len(buf) - 1)] & ~white[ends - 1]
        order = np.argsort(~plain, kind="stable")
        units, size = [found[i] for i in order.tolist()], size[order]
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        buf, ends = np.frombuffer(b"".join(units), np.uint8), np.cumsum(size)
        a = self.encode_a(units, int(plain.sum()))
        n_a = np.diff(np.concatenate([[0], np.searchsorted(np.cumsum(self.a.width[a]), ends, "right")]))
        # B puts the space in front itself
        lists = self.b.encode([u[1:].decode() for u in units], num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        told = np.concatenate([[0], np.cumsum(self.b_width[b])])
        good = np.diff(told[np.concatenate([[0], np.cumsum(n_b)])]) == size
        bytes_of = lambda ids: ragged(self.b_pool, self.b_width, ids)
        if good.any():
            same = bytes_of(ragged(b, n_b, np.flatnonzero(good))) == ragged(buf, size, np.flatnonzero(good))
            good[np.flatnonzero(good)] = np.logical_and.reduceat(same, np.cumsum(size[good]) - size[good])
        keep = np.flatnonzero(good)
        a, b = ragged(a, n_a, keep), ragged(b, n_b, keep)
        n_a, n_b, ends = n_a * good, n_b * good, np.cumsum(size * good)
        text = labels(int(size[keep].sum()), self.a.width[a], self.b_width[b])
        label = np.frombuffer(text, np.uint8) - NONE
        is_a, is_b = (label & 1).astype(np.int64), (label >> 1).astype(np.int64)
        all_a, all_b, all_ = (np.concatenate([[0], np.cumsum(x)]) for x in (is_a, is_b, label > 0))
        stop = group_ends(text)
        # two tokens that overlap do so up to a byte where one ends, and there they are the tokens at hand
        at = np.flatnonzero(label)
        pairs = a[all_a[at]] * PAIR + b[all_b[at]]
        groups, edge = group_texts(a, b, np.diff(all_a[np.concatenate([[0], stop])]), np.diff(all_b[np.concatenate([[0], stop])]))
        cut = edge[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        per = lambda values: np.diff(np.concatenate([[0], values]))
        return Units(rank, good, n_a, n_b, per(np.searchsorted(stop, ends, "right")), per(all_[ends]), pairs, [groups[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)])

    def cut(self, column) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct units of texts, a space in front of each text that has any byte; for each unit of the texts in order its place among them, and for each text the place of its first unit."""
        raw, offs = tb.to_bytes(column)
        full = np.flatnonzero(np.diff(offs))
        sizes = np.diff(offs)[full]
        buf = np.full(len(raw) + len(full), 32, np.uint8)
        buf[np.arange(len(raw)) + np.repeat(np.arange(1, len(full) + 1), sizes)] = raw
        begin = offs[full] + np.arange(len(full))
        white = tb.SPACE[buf] | wide_space(buf)
        first = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            first[1 : len(buf) - 1] = (buf[1:-1] == 32) & ~white[:-2] & ~white[2:]
        # a space that ends a text stays with it, and the byte behind it is another text's
        last = begin[1:] - 1
        first[last] = False
        first[begin] = True
        starts = np.flatnonzero(first[: len(buf)])
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        flat = buf.tobytes()
        _, some, inverse = tb.unique(tb.hash_spans(buf, starts, ends)) if len(starts) else (None, np.zeros(0, int), np.zeros(0, int))
        found = [flat[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        if len(starts) and not same_bytes(buf, starts, ends, some[inverse]):
            places: dict[bytes, int] = {}
            inverse = np.array([places.setdefault(flat[s:e], len(places)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            found = list(places)
        bounds = np.zeros(len(offs), np.int64)
        own = np.zeros(len(offs) - 1, np.int64)
        own[full] = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
        bounds[1:] = np.cumsum(own)
        return found, inverse, bounds


def wide_space(buf: np.ndarray) -> np.ndarray:
    """Bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+205F as one, U+3000)."""
    out = np.zeros(len(buf) + 2, bool)
    padded = np.concatenate([buf, np.zeros(2, np.uint8)])
    for lead, second, width in ((0xC2, (0x85, 0xA0), 2), (0xE1, (0x9A,), 3), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(buf == lead)
        at = at[np.isin(padded[at + 1], second)]
        for k in range(width):
            out[at + k] = True
    return out[: len(buf)]


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the bytes of the span whose place like gives."""
    size = ends - starts
    if not (size == size[like]).all():
        return False
    total = np.cumsum(size)
    at = 0
    while at < len(starts):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + tb.SLICE, "right")))
        own = size[at:to]
        place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        if not (buf[np.repeat(starts[at:to], own) + place] == buf[np.repeat(starts[like[at:to]], own) + place]).all():
            return False
        at = to
    return True


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


#: A batch: its documents; its distinct pairs and how many documents hold each; for each document, in turn, the numbers of its distinct pairs and how many links each has, and how many there are of these.
BATCH = "batch long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, pair array<bigint>, held array<bigint>, at array<int>, times array<int>, n_at array<int>"


def ragged(values: np.ndarray, lengths: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The runs of values (of lengths) that take names, one after another."""
    own = lengths[take]
    stop = np.cumsum(own)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.arange(total) + np.repeat((np.cumsum(lengths) - lengths)[take] - stop + own, own)]


def align(rows: pa.RecordBatch, tool: Aligner, number: int) -> pa.RecordBatch:
    """One row of BATCH for rows (doc_id, text)."""
    found, place, bounds = tool.cut(rows.column("text"))
    units = tool.solve(found)
    place = units.rank[place]
    n = rows.num_rows
    bad = np.concatenate([[0], np.cumsum(~units.good[place])])
    whole = (np.diff(bounds) > 0) & (np.diff(bad[bounds]) == 0)
    sums = lambda values: np.where(whole, np.diff(np.concatenate([[0], np.cumsum(values[place])])[bounds]), 0)
    n_a, n_b, n_groups = sums(units.n_a), sums(units.n_b), sums(units.n_groups)
    texts, where, edges = units.texts, place.tolist(), bounds.tolist()
    sha = [hashlib.sha256(b"".join([texts[i] for i in where[s:e]])[:-1]).hexdigest() if ok else "" for s, e, ok in zip(edges[:-1], edges[1:], whole.tolist(), strict=True)]
    # the distinct pairs of each document, as numbers among those of the batch
    lengths = units.n_links
    pair, number_of = np.unique(units.pairs, return_inverse=True)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    take = whole[doc] if n else np.zeros(0, bool)
    links = ragged(number_of, lengths, place[take])
    of = np.repeat(doc[take], lengths[place[take]])
    key, times = np.unique(of * max(1, len(pair)) + links, return_counts=True)
    of, at = key // max(1, len(pair)), key % max(1, len(pair))
    held = np.bincount(at, minlength=len(pair))
    used = held > 0  # pairs of documents that have no tokens don't count
    at = (np.cumsum(used) - 1)[at] if len(at) else at
    one = lambda values, kind: pa.array([values.tolist() if isinstance(values, np.ndarray) else values], pa.list_(kind))
    flat = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    columns = [pa.array([number], pa.int64()), one(rows.column("doc_id").to_pylist(), pa.int64())]
    columns += [flat(x, pa.int64()) for x in (n_a, n_b, n_groups, np.bincount(of, times, n).astype(np.int64))]
    columns += [one(sha, pa.string()), flat(pair[used], pa.int64()), flat(held[used], pa.int64()), flat(at, pa.int32()), flat(times, pa.int32()), flat(np.bincount(of, minlength=n), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "held", "at", "times", "n_at"])


def align_rows(a_path: str, b_path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in tb.pieces(batch, size=size):
                yield align(rows, tool, number)
                number += 1

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each batch, from its row and what it has been told (pair, count, whether no pair of its id of A has a larger one)."""
    for batch in batches:
        for row in batch.to_struct_array():
            get = lambda name: row[name].values  # noqa: B023, E731
            pair, at, times = (get(x).to_numpy() if get(x) is not None else np.zeros(0, np.int64) for x in ("pair", "at", "times"))
            n_at = get("n_at").to_numpy()
            told = get("told")
            count, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            if told is not None and len(told):
                place = np.searchsorted(pair, told.field("pair").to_numpy())
                count[place] = told.field("count").to_numpy()
                best[place] = told.field("best").to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(n_at)])
            total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[edge])  # noqa: B023, E731
            columns = [get(x) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(total(times * best[at]), pa.int64()), pa.array(total(times * count[at]), pa.int64()), get("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, count, best) of all pairs: the documents that hold it, and whether no other pair of its id of A has more."""
    counts = batches.select(F.inline(F.arrays_zip("pair", "held"))).groupBy("pair").agg(F.sum("held").alias("count")).checkpoint()
    a = F.shiftright("pair", PAIR.bit_length() - 1).alias("a")
    # one row for each id of A at most
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, size: int = GROUP) -> DataFrame:
    """Digests of the groups and links of docs (doc_id, text) between tokenizers A (byte-level, a tokenizer file) and B (a piece model)."""
    shared.checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    batches = shared.written(rows.mapInArrow(align_rows(a_path or packing.vocabulary(), b_path or pieces.model_path(), size), BATCH), ROW_GROUP)
    asked = batches.select("batch", F.explode("pair").alias("pair"))
    told = asked.join(pair_counts(batches).hint("merge"), "pair").groupBy("batch").agg(F.collect_list(F.struct("pair", "count", "best")).alias("told"))
    return batches.join(told.hint("merge"), "batch", "left").mapInArrow(counted, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
