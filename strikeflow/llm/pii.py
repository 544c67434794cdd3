"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans. The field adds spans to them: it scores whole
segments of up to LONGEST words as email, ip, card, phone or other, by features
of the segment as a whole (its shape, its digits, words and separators, what
stands before it), and dynamic programming over segment ends and types finds the
best boundaries and types of a stretch together. Only words that hold a digit or
an at sign can begin or end an entity, so the field runs over stretches of such
words and their brackets; all other words are `other` in any labelling.

Training maximises the likelihood of the base spans in the stretches of about
SAMPLE documents (see shared.sample), MOST stretches at most, in the order of the sample. Digits that miss the checksum are examples
of `other`. Stretches with an address or a phone number that fails its check are
left out: the greedy pattern may have run into the words that follow, and the
field finds the number inside. Long stretches are cut between base spans. A span of the best labelling is added if its log odds
against `other` for the same words exceed MARGIN and no base span overlaps it.

Results: a null text is an empty one and has no spans. A stretch may have any
length; time is linear in it, and memory a few numbers a word: of the lattice only
the last LONGEST columns are ever held. Repeated rows are searched each. Other columns are
ignored. An empty table gives no rows. n_email to n_phone count base spans.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LONGEST = 4
SAMPLE = 5000
ROUNDS, RATE, DECAY = 12, 0.3, 1e-4
MARGIN = 2.0
#: The most training stretches, and the words from which on one is cut.
MOST, CUT = 6000, 40
#: Segments of at most so many characters have their scores kept, so many of them.
KEPT_CHARS, KEPT = 64, 1 << 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a failing start inside a run of digits fails from each of its digits
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HIT = re.compile(r"[0-9@]")
_ALNUM = re.compile(r"[0-9A-Za-z]")
_END = re.compile(r"[0-9A-Za-z)]")


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in digits[::-1]]
    return (sum(values[::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, kind, end) in order, and the matches of ip and phone that fail their check."""
    found, failed = [], []
    if not _ANY.search(text):
        return found, failed
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
        else:
            failed.append(m.span())
    for m in _CARD.finditer(text):
        digits = only_digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(only_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
        else:
            failed.append(m.span())
    return sorted(found), failed


Words = tuple[array, array]


def stretches(text: str) -> Iterator[Words]:
    """Starts and ends of the words of each run of words that hold a digit or an at sign."""
    starts, ends = array("q"), array("q")
    at = 0
    while m := _HIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        if ends and text[ends[-1] : start].strip(" \t\n\x0b\x0c\r"):
            yield starts, ends
            starts, ends = array("q"), array("q")
        at = _WORD.match(text, start).end()
        starts.append(start)
        ends.append(at)
    if starts:
        yield starts, ends


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """From the first letter or digit, and brackets and plus signs right before it, to the last one, or closing bracket."""
    m = _ALNUM.search(text, start, end)
    if not m:
        return start, end
    begin = m.start()
    while begin > start and text[begin - 1] in "(+":
        begin -= 1
    while end > m.end() and not _END.match(text, end - 1):
        end -= 1
    return begin, end


_ZEROS = {48 + d: "0" for d in range(1, 10)}
_SHAPE = re.compile(r"([0-9]+)|([A-Za-zÀ-￿]+)")


def shape(text: str) -> str:
    return _SHAPE.sub(lambda m: f"d{min(m.end() - m.start(), 20)}" if m.group(1) else "a", text)


def segment_features(text: str, start: int, end: int, words: int) -> list[str]:
    body = text[start:end]
    digits = sum("0" <= c <= "9" for c in body)
    letters = sum(c.isalpha() for c in body)
    return [
        "",
        f"s{shape(body)}",
        f"n{words}",
        f"d{min(digits, 20)}",
        f"sum{luhn(only_digits(body)) if 12 <= digits <= 19 and not letters else None}",
        f"l{min(letters, 3)}",
        f"@{body.count('@')}",
        f".{min(body.count('.'), 4)}",
        f"+{body[:1] == '+'}",
        f"(){'(' in body},{'-' in body},{' ' in body}",
        f"<{re.sub('[0-9]', '0', text[max(0, start - 2) : start])}",
    ]


class Field:
    """weights[feature]: one number for each kind and for other."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.kept: dict[tuple, tuple[float, int, float]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "kept": {}}

    def score(self, names: list[str]) -> np.ndarray:
        total = np.zeros(OTHER + 1)
        for n in names:
            w = self.weights.get(n)
            if w is not None:
                total += w
        return total

    def lattice(self, text: str, words: Words) -> dict[tuple[int, int], tuple[int, int, list[str]]]:
        """Segments (i, j) of words: their trimmed span and features. For training, on stretches of a bounded length."""
        out = {}
        for j in range(1, len(words[0]) + 1):
            for i in range(max(0, j - LONGEST), j):
                start, end = core(text, words[0][i], words[1][j - 1])
                out[i, j] = (start, end, segment_features(text, start, end, j - i))
        return out

    def sums(self, n: int, scores: dict) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log sums; other takes one word."""
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        total = {k: np.logaddexp.reduce(s) for k, s in scores.items()}
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[i] + total[i, j] for i in range(max(0, j - LONGEST), j)])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[j] + total[i, j] for j in range(i + 1, min(n, i + LONGEST) + 1)])
        return ahead, behind

    def scores(self, lattice: dict) -> dict:
        out = {}
        for (i, j), (_, _, names) in lattice.items():
            s = self.score(names)
            if j - i > 1:
                s[OTHER] = -np.inf
            out[i, j] = s
        return out

    def fit(self, examples: list[tuple[dict, int, set]]) -> None:
        """examples: lattice, number of words, true segments (i, j, kind). Adaptive gradient ascent."""
        squares: dict[str, np.ndarray] = defaultdict(lambda: np.full(OTHER + 1, 1e-6))
        order = np.random.default_rng(7)
        for _ in range(ROUNDS):
            for k in order.permutation(len(examples)):
                lattice, n, gold = examples[k]
                scores = self.scores(lattice)
                ahead, behind = self.sums(n, scores)
                for (i, j), (_, _, names) in lattice.items():
                    g = -np.exp(ahead[i] + scores[i, j] + behind[j] - ahead[n])
                    for kind in range(OTHER + 1):
                        if (i, j, kind) in gold:
                            g[kind] += 1
                    if np.abs(g).max() < 1e-4:
                        continue
                    for name in names:
                        w = self.weights.get(name)
                        if w is None:
                            w = self.weights[name] = np.zeros(OTHER + 1)
                        step = g - DECAY * w
                        squares[name] += step * step
                        w += RATE * step / np.sqrt(squares[name])

    def segment(self, text: str, start: int, end: int, words: int) -> tuple[float, int, float]:
        """The best score of a segment and its kind, and the score of `other`, which takes one word."""
        start, end = core(text, start, end)
        key = None
        if end - start <= KEPT_CHARS:
            body = text[start:end]
            # all that features see of digits is how many there are, and a checksum
            key = (body.translate(_ZEROS), words, text[max(0, start - 2) : start].translate(_ZEROS), 12 <= len(body) and luhn(only_digits(body)))
            if key in self.kept:
                return self.kept[key]
        s = self.score(segment_features(text, start, end, words))
        other = float(s[OTHER]) if words == 1 else -np.inf
        s[OTHER] = other
        kind = int(s.argmax())
        found = float(s[kind]), kind, other
        if key is not None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[key] = found
        return found

    def best(self, text: str, words: Words) -> tuple[float, list[tuple[int, int, int, float]]]:
        """The score of the best labelling, and its segments (i, j, kind, log odds against `other`) that aren't `other`."""
        starts, ends = words
        n = len(starts)
        best, gain, other = array("d", [0.0]) * (n + 1), array("d", [0.0]) * (n + 1), array("d", [0.0]) * (n + 1)
        size, kinds = bytearray(n + 1), bytearray(n + 1)
        for j in range(1, n + 1):
            top = -np.inf
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                score, kind, alone = self.segment(text, starts[i], ends[j - 1], j - i)
                if i == j - 1:
                    other[j] = other[i] + alone
                if (x := best[i] + score) > top:
                    top, size[j], kinds[j], gain[j] = x, j - i, kind, score
            best[j] = top
        found, j = [], n
        while j:
            i = j - size[j]
            if kinds[j] != OTHER:
                found.append((i, j, kinds[j], gain[j] - (other[j] - other[i])))
            j = i
        return best[n], found[::-1]

    def decode(self, text: str, words: Words) -> Iterator[tuple[int, int, int]]:
        """Spans (start, kind, end) of the best labelling that beat `other` by MARGIN."""
        for i, j, kind, odds in self.best(text, words)[1]:
            if odds > MARGIN:
                start, end = core(text, words[0][i], words[1][j - 1])
                yield start, kind, end


def examples(text: str, field: Field) -> Iterator[tuple[dict, int, set]]:
    """Training stretches of a text, cut between base spans into CUT words or a few more."""
    spans, failed = base_spans(text)
    for starts, ends in stretches(text):
        at = 0
        while at < len(starts):
            to = min(len(starts), at + CUT)
            while to < len(starts) and to < at + 2 * CUT and any(a < ends[to - 1] and b > starts[to] for a, _, b in spans):
                to += 1
            yield from example(text, (starts[at:to], ends[at:to]), spans, failed, field)
            at = to


def example(text: str, words: Words, spans: list, failed: list, field: Field) -> Iterator[tuple[dict, int, set]]:
    low, high = words[0][0], words[1][-1]
    if any(a < high and b > low for a, b in failed):
        return
    lattice = field.lattice(text, words)
    gold, covered = set(), set()
    for start, kind, end in (s for s in spans if s[0] < high and s[2] > low):
        for (i, j), (a, b, _) in lattice.items():
            if (a, b) == (start, end) and not covered & set(range(i, j)):
                gold.add((i, j, kind))
                covered |= set(range(i, j))
                break
        else:
            return
    n = len(words[0])
    yield lattice, n, gold | {(i, i + 1, OTHER) for i in range(n) if i not in covered}


def train(texts: list[str], most: int = MOST) -> Field:
    field, found = Field(), []
    for text in texts:
        if text and _ANY.search(text):
            for x in examples(text, field):
                found.append(x)
                if len(found) >= most:
                    break
        if len(found) >= most:
            break
    if any(kind != OTHER for _, _, gold in found for _, _, kind in gold):
        field.fit(found)
    return field


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (start, kind, end) in order."""
    base, _ = base_spans(text)
    if not field.weights or not _ANY.search(text):
        return base, base
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    added = []
    for words in stretches(text):
        for start, kind, end in field.decode(text, words):
            before = bisect_left(starts, end)  # base spans that begin before this one ends
            if not before or reach[before - 1] <= start:
                added.append((start, kind, end))
    return base, sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or spans that overlap, replaced by the first one's kind in brackets."""
    out, at, last = [], 0, -1
    for start, kind, end in spans:
        if start >= last:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = last = end
        elif end > last:
            at = last = end
    return "".join([*out, text[at:]])


def search(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shipped.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):  # one at a time
                text = text.as_py() or ""
                base, spans = find(text, field)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def fit(docs: DataFrame, limit: int = SAMPLE) -> Field:
    rows = shared.sample(docs.select("doc_id", "text", F.lit("").alias("label")), limit)
    return train(rows.column("text").to_pylist())


def detect(docs: DataFrame, *, limit: int = SAMPLE) -> DataFrame:
    """Spans of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, limit))
    return docs.mapInArrow(search(field), SCHEMA)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
