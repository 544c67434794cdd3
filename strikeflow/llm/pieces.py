"""SentencePiece encoding and decoding by unigram Viterbi.

Pieces are held in a double-array trie: from state s, byte b leads to state
base[s] + b if check there names s. A text is normalised as the model asks (a
space is the marker, and one is put in front), and the best segmentation is the
path of pieces with the largest sum of log scores. A character that no path of
pieces covers falls back to the pieces of its bytes. Decoding joins pieces, turns
byte pieces back into bytes and markers into spaces, and drops the first.

The Viterbi runs over the words of a batch together: equal words are solved
once, and words are lanes of arrays, so that a step moves all of them by one
byte. Texts are cut only where no piece can cross: in front of a run of markers,
and around characters that occur in no longer piece. Words over LANE bytes are
solved one by one, in time linear in their length.

The model file holds merge ranks as scores. A unigram model needs log
probabilities; score(rank) = -log(rank + FIRST_RANK) gives them by Zipf's law.

Results: a null or empty text has no ids and decodes to ''. Decoding gives the
text, with any marker character of its own turned into a space. Repeated rows are
encoded each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import textbytes as tb

MARK = "▁"
FIRST_RANK = 100
SLICE = 4 << 20
LANE = 256
#: Below the least score of a piece, for a character that falls back to bytes.
PENALTY = 10.0


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """A double array. value[s]: the piece that ends in state s, or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, value in words.items():
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = value
        size = 2 * len(children) + 512
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        start, queue = 1, [(0, 0)]
        for node, state in queue:
            value[state] = ends[node]
            keys = sorted(children[node])
            if not keys:
                continue
            first, rest = keys[0], [k - keys[0] for k in keys[1:]]
            start = used.find(0, start)
            # where many children are to fit, dense parts at the front aren't searched again
            at = max(start, first) if len(keys) < 3 else max(start, first, len(queue) - 256)
            while True:
                at = used.find(0, at)
                if at < 0 or at + 512 >= len(used):
                    at = at if at >= 0 else len(used)
                    grow = len(used)
                    used += bytearray(grow)
                    base, check, value = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                if not any(used[at + r] for r in rest):
                    break
                at += 1
            base[state] = at - first
            for b in keys:
                to = at - first + b
                used[to], check[to] = 1, state
                queue.append((children[node][b], to))
        # every state and byte leads to a place in the arrays
        size = int(base.max()) + 256
        self.base, self.check, self.value = (np.concatenate([x[:size], np.full(max(0, size - len(x)), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        self.text: list[bytes] = []
        words = {}
        self.score = np.zeros(n)
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        for rank, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i))):
            self.score[i] = -math.log(rank + FIRST_RANK)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:-1], 16)
                self.byte_id[b] = i
                self.text.append(bytes([b]))
            elif self.score[i]:
                words[piece.replace(MARK, " ").encode()] = i
                self.text.append(piece.replace(MARK, " ").encode())
            else:
                self.text.append(b"")
        self.trie = Trie(words)
        self.words = words
        self.longest = max(map(len, words))
        self.fallback = float(self.score.min()) - PENALTY
        inner = set(b"".join(w for w in words if len(w) > 1))
        self.lone = np.zeros(256, bool)
        self.lone[[b for b in range(128) if b not in inner and b != 32]] = True
        # a cut in front of a marker is safe if no piece holds one after another character
        self.cuts = not any(b" " in w.lstrip(b" ") for w in words)
        self.width = np.array([len(x) for x in self.text])
        self.pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.place = np.cumsum(self.width) - self.width

    def _lanes(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (padded, each row from its last id to its first), their numbers, and the scores of words, one a row."""
        n, most = text.shape
        trie = self.trie
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((most + 1, n), np.int16), np.zeros((most + 1, n), np.int32)
        head = (text & 0xC0) != 0x80
        for i in range(most):
            live = np.flatnonzero((size > i) & head[:, i])
            if not len(live):
                continue
            base = best[i, live]
            state, rows, score = np.zeros(len(live), np.int32), live, base
            for j in range(i, min(most, i + self.longest)):
                to = trie.base[state] + text[rows, j]
                ok = (trie.check[to] == state) & (size[rows] > j)
                state, rows, score = to[ok], rows[ok], score[ok]
                if not len(rows):
                    break
                end = np.flatnonzero(trie.value[state] >= 0)
                ids = trie.value[state[end]]
                total = score[end] + self.score[ids]
                better = total > best[j + 1, rows[end]]
                w = rows[end[better]]
                best[j + 1, w], back[j + 1, w], piece[j + 1, w] = total[better], i, ids[better]
            # bytes of the character at i, where they beat what ends with it so far
            lead = text[live, i]
            width = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            stop = np.minimum(i + width, size[live])
            fall = base + self.fallback > best[stop, live]
            w, stop, base = live[fall], stop[fall], base[fall]
            best[stop, w] = base + self.fallback
            for k in range(4):
                on = i + k < stop
                if not on.any():
                    break
                back[i + k + 1, w[on]], piece[i + k + 1, w[on]] = i + k, self.byte_id[text[w[on], i + k]]
        ids, count = np.zeros((n, most), np.int32), np.zeros(n, np.int64)
        at, rows = size.astype(np.int64), np.arange(n)
        while len(rows):
            ids[rows, count[rows]] = piece[at, rows]
            count[rows] += 1
            at = back[at, rows].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        return ids, count, best[size, np.arange(n)]

    def _long(self, word: bytes) -> tuple[list[int], float]:
        """One word, by the same rules."""
        n = len(word)
        best, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self._lists()
        for i in range(n):
            if word[i] & 0xC0 == 0x80:
                continue
            state = 0
            for j in range(i, min(n, i + self.longest)):
                to = base[state] + word[j]
                if check[to] != state:
                    break
                state = to
                v = value[state]
                if v >= 0 and best[i] + score[v] > best[j + 1]:
                    best[j + 1], back[j + 1] = best[i] + score[v], (i, v)
            b = word[i]
            stop = min(n, i + (1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4))
            if best[i] + self.fallback > best[stop]:
                best[stop] = best[i] + self.fallback
                for k in range(i, stop):
                    back[k + 1] = (k, int(self.byte_id[word[k]]))
        out, at = [], n
        while at:
            at, v = back[at]
            out.append(v)
        return out[::-1], best[n]

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score))
        return self._as_lists

    def encode(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, n + 1 offsets, and the log score of each text."""
        raw, offs = tb.to_bytes(column)
        n = len(offs) - 1
        full = np.flatnonzero(np.diff(offs))
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n)
        mark = np.frombuffer(MARK.encode(), np.uint8)
        own = np.flatnonzero((raw[:-2] == mark[0]) & (raw[1:-1] == mark[1]) & (raw[2:] == mark[2])) if len(raw) > 2 else []
        if len(own):
            keep = np.ones(len(raw), bool)
            keep[own + 1] = keep[own + 2] = False
            raw = raw.copy()
            raw[own] = 32
            raw, offs = raw[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
        # a marker in front of each text
        sizes = np.diff(offs)
        buf = np.full(len(raw) + len(full), 32, np.uint8)
        buf[np.arange(len(raw)) + np.repeat(np.arange(1, len(full) + 1), sizes[full])] = raw
        begin = offs[full] + np.arange(len(full))
        first = np.zeros(len(buf), bool)
        first[begin] = True
        if self.cuts:
            first[1:] |= (buf[1:] == 32) & (buf[:-1] != 32)
        lone = self.lone[buf]
        first |= lone
        first[1:] |= lone[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(buf))
        _, some, inverse = tb.unique(tb.hash_spans(buf, starts, ends))
        s, size = starts[some], (ends - starts)[some]
        ids, count, score = self._solve(buf, s, size)
        place = np.cumsum(count) - count
        own = count[inverse]
        stop = np.cumsum(own)
        out = ids[np.arange(int(stop[-1])) + np.repeat(place[inverse] - stop + own, own)]
        unit = np.searchsorted(starts, begin)
        bounds = np.zeros(n + 1, np.int64)
        per = np.zeros(n, np.int64)
        per[full] = np.add.reduceat(own, unit)
        bounds[1:] = np.cumsum(per)
        total = np.zeros(n)
        total[full] = np.add.reduceat(score[inverse], unit)
        return out, bounds, total

    def _solve(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count, score = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (6, 10, 16, 32, 64, 128, LANE):
            group = np.flatnonzero((size > low) & (size <= high))
            low = high
            for at in range(0, len(group), 1 << 15):
                rows = group[at : at + (1 << 15)]
                place = starts[rows][:, None] + np.arange(high)
                text = buf[np.minimum(place, len(buf) - 1)]
                ids, own, score[rows] = self._lanes(text, size[rows])
                count[rows] = own
                # rows run from the last id to the first
                k = np.cumsum(own)
                flat = np.repeat(own, own) - 1 - (np.arange(int(k[-1])) - np.repeat(k - own, own))
                found.append((rows, ids[np.repeat(np.arange(len(rows)), own), flat]))
        for i in np.flatnonzero(size > LANE):
            ids, score[i] = self._long(buf[starts[i] : starts[i] + size[i]].tobytes())
            count[i] = len(ids)
            found.append((np.array([i]), np.array(ids, np.int32)))
        out, place = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
        for rows, ids in found:
            own = count[rows]
            k = np.cumsum(own)
            out[np.arange(len(ids)) + np.repeat(place[rows] - k + own, own)] = ids
        return out, count, score

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of id sequences."""
        width = self.width[ids]
        stop = np.cumsum(width)
        total = int(stop[-1]) if len(stop) else 0
        raw = self.pool[np.arange(total) + np.repeat(self.place[ids] - stop + width, width)].tobytes()
        edge = np.concatenate([[0], stop])[bounds].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, log_score double, decoded_bytes long, decoded_sha256 string"


def encode_rows(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shipped.value
        is_byte = np.zeros(len(pieces.text), bool)
        is_byte[pieces.byte_id] = True
        for batch in batches:
            for rows in tb.pieces(batch, size=SLICE):
                ids, bounds, score = pieces.encode(rows.column("text"))
                data = ids.astype("<u4").tobytes()
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
                texts = pieces.decode(ids, bounds)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.diff(bytes_before[bounds])), pa.array(crc, pa.int64()), pa.array(score), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "log_score", "decoded_bytes", "decoded_sha256"])

    return run


def encode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Digests of the ids of docs (doc_id, text) and of the text that they decode to."""
    pieces = docs.sparkSession.sparkContext.broadcast(load(path or model_path()))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode_rows(pieces), SCHEMA)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
