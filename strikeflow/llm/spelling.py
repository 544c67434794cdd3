"""Spelling variants, grouped under their commonest form by sorted dictionaries read forward and reversed.

Words are counted over all documents; those that are long and frequent enough are
the dictionary. If two words of lengths m and m or m + 1 differ by one edit, the first half
of the shorter one stands unchanged at the front of the other, or its last half at the back.
So each word enters the forward dictionary by its first half and the reversed one by its
last half, reversed (twice each, as the shorter and as the longer word of a pair).
Dictionaries are range-partitioned and sorted, and each block of a shared half is scanned
once. An edit counts at the place where the words first differ, and only the block whose
open half holds this place tells the pair, so each pair comes up once.

Blocks are counted before any row meets another. The rows of a block over BUCKET words
are dealt out again: its open part is halved, one half of which stands unchanged as well,
and so on until blocks are small or one place is left open. Then pairs of equal length share all
but one character, and a longer word shares all of the shorter one, so such a block has no
more words than the alphabet has letters, one more at most: no block grows with the dictionary.

A word's form is its near word of largest count, if that is FACTOR times its own or more. Counts
grow by FACTOR from form to form, so chains are short; roots are found by doubling.

Results: one row for each word of the dictionary. A null text has no words; a null doc_id
counts as empty where words are altered. Repeated rows count each. Words and texts of any
length are taken whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared

LETTERS = "A-Za-zÀ-ÿ"
LENGTH, COUNT = 6, 5
FACTOR = 5
#: One word in so many (by doc_id and word) loses a letter, for want of misspelt texts; 0: none.
ALTERED = 199
#: The most words of a block that are scanned together.
BUCKET = 128
#: Bytes of words that are compared at once.
CHUNK = 1 << 20


def lowered(word: Column) -> Column:
    """A-Z in lower case, other capitals kept."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(word.rlike("[À-Þ]"), F.translate(word, upper, upper.lower())).otherwise(F.lower(word))


def dictionary(docs: DataFrame, *, length: int = LENGTH, count: int = COUNT, altered: int = ALTERED) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) of so many letters, and so frequent, at least."""
    runs = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run")).select("doc", lowered(F.col("run")).alias("word"))
    if altered:
        hashed = words.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        words = hashed.select(F.when(F.col("h") % altered == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def ends() -> tuple[Column, Column]:
    """What a row (word, m, lo, hi) shares with its block: what stands before the open part and what stands after it."""
    after = F.col("hi") + F.length("word") - F.col("m")
    return F.substring("word", F.lit(1), F.col("lo")), F.substring("word", after + 1, F.length("word"))


def entry() -> Column:
    """A row's place in the dictionaries: forward by what stands before the open part, or reversed by what stands after it first."""
    front, back = ends()
    place = F.concat_ws(":", F.col("m"), F.col("lo"), F.col("hi"))
    return F.when(back == "", F.concat(F.lit("f"), front, F.lit(":"), place)).otherwise(F.concat(F.lit("r"), F.reverse(back), F.lit(":"), front, F.lit(":"), place))


def halves(words: DataFrame, length: int) -> DataFrame:
    """(word, n, m, lo, hi): each word as the shorter one (m letters) and as the longer one of a pair, with each half open. Places of edits run from lo to hi - 1."""
    size = F.length("word")
    roles = words.select("word", "n", F.explode(F.when(size > length, F.array(size, size - 1)).otherwise(F.array(size))).alias("m"))
    mid = F.floor(F.col("m") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), (F.col("m") + 1).alias("hi")))
    return roles.select("word", "n", "m", F.inline(parts))


def divided(rows: DataFrame) -> DataFrame:
    """rows of crowded blocks with half the open part each; with one place open, rows of equal length apart from those that hold one letter more there (lo = hi)."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = F.floor((lo + hi) / 2).cast("int")
    part = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    last = F.when(F.length("word") == F.col("m"), F.array(part(lo, hi), part(lo, lo))).otherwise(F.array(part(lo, lo)))
    return rows.select("word", "n", "m", F.inline(F.when(hi - lo > 1, F.array(part(lo, mid), part(mid, hi))).otherwise(last)), (hi - lo == 1).alias("last"))


def matrix(words: pa.Array) -> np.ndarray:
    """A row of letters for each word (all are under U+0100), zeros behind."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    width = max(map(len, raw)) + 1
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)


def near_in_blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows (sorted, whole blocks) that are one edit apart at a place that their block leaves open."""
    m, lo, hi = (rows.column(c).to_numpy() for c in ("m", "lo", "hi"))
    hi = np.maximum(hi, lo + 1)
    size = pc.utf8_length(rows.column("word")).to_numpy().astype(np.int64)
    letters = matrix(rows.column("word").combine_chunks())
    key = rows.column("entry").combine_chunks().dictionary_encode().indices.to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CHUNK // letters.shape[1])
    for shift in range(1, len(key)):
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(same):
            break  # blocks are contiguous
        for at in range(0, len(same), step):
            a = same[at : at + step]
            b = a + shift
            short = np.where(size[a] <= size[b], a, b)
            long = a + b - short
            ok = size[short] == m[short]  # not two of the longer ones
            short, long = short[ok], long[ok]
            x, y = letters[short], letters[long]
            differ = x != y
            first = differ.argmax(1)
            # behind the first difference: nothing else, or all of it one place on
            one = differ.sum(1) == 1
            moved = x[:, :-1] != y[:, 1:]
            last = np.where(moved.any(1), moved.shape[1] - 1 - moved[:, ::-1].argmax(1), -1)
            near = np.where(size[short] == size[long], one, last < first) & (first >= lo[short]) & (first < hi[short])
            found.append((short[near], long[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, from sorted rows; the last block of a batch waits for the next one."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # blocks of long words are compared apart
        change = np.flatnonzero(pc.not_equal(rows.column("entry").combine_chunks()[1:], rows.column("entry").combine_chunks()[:-1]).to_numpy(zero_copy_only=False)) + 1 if rows.num_rows > 1 else np.zeros(0, np.int64)
        edges = np.concatenate([[0], change, [rows.num_rows]])
        width = pc.utf8_length(rows.column("word")).to_numpy().astype(np.int64) + 1
        begin = 0
        while begin < len(edges) - 1:
            end, most = begin, 0
            while end < len(edges) - 1:
                most = max(most, int(width[edges[end] : edges[end + 1]].max()))
                if end > begin and most * int(edges[end + 1] - edges[begin]) > CHUNK:
                    break
                end += 1
            own = rows.slice(int(edges[begin]), int(edges[end] - edges[begin]))
            short, long = near_in_blocks(own)
            if len(short):
                one, other = np.concatenate([short, long]), np.concatenate([long, short])
                word, n = own.column("word").combine_chunks(), own.column("n").combine_chunks()
                yield pa.RecordBatch.from_arrays([word.take(pa.array(one)), word.take(pa.array(other)), n.take(pa.array(other))], names=["word", "near", "near_n"])
            begin = end

    waiting: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        if not rows.num_rows:
            continue
        entries = rows.column("entry").combine_chunks()
        keep = pc.equal(entries, entries[len(entries) - 1]).to_numpy(zero_copy_only=False)
        cut = int(keep.argmax())
        yield from told(rows.slice(0, cut)) if cut else ()
        waiting = rows.slice(cut)
    if waiting is not None:
        yield from told(waiting)


def near_words(words: DataFrame, *, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(word, near, near_n): the ordered pairs of words (word, n) one edit apart, each once."""
    rows, out = halves(words, length).withColumn("last", F.lit(False)), []
    while True:
        keyed = rows.withColumn("key", F.xxhash64(*ends(), "m", "lo", "hi"))  # two blocks of one key would only be counted as one
        sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.length("word") == F.col("m")).alias("short")).where("rows > 1 and short > 0").select("key", "rows").checkpoint()
        met = shared.written(keyed.join(sizes.hint("merge"), "key").drop("key"))
        small = met.where((F.col("rows") <= bucket) | F.col("last")).select("word", "n", "m", "lo", "hi", entry().alias("entry"))
        out.append(small.repartitionByRange("entry").sortWithinPartitions("entry", "word").mapInArrow(scan, "word string, near string, near_n long"))
        crowded = met.where((F.col("rows") > bucket) & ~F.col("last"))
        if not crowded.limit(1).count():
            return reduce(DataFrame.unionAll, out)
        rows = divided(crowded)


def roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the last one on the way from form to form."""
    up = words.where("form is not null").select("word", F.col("form").alias("root")).checkpoint()
    while True:
        # each round doubles the steps
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        up = joined.select("word", "root")
        if not joined.where("moved").limit(1).count():
            return up


def variants(docs: DataFrame, *, length: int = LENGTH, count: int = COUNT, altered: int = ALTERED, factor: int = FACTOR, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the dictionary of docs (doc_id, text)."""
    shared.checkpoint_dir(docs.sparkSession)
    words = shared.written(dictionary(docs, length=length, count=count, altered=altered))
    best = near_words(words, length=length, bucket=bucket).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    formed = F.col("best.less") * -1 >= F.col("n") * factor
    told = shared.written(words.join(best, "word", "left").select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")))
    return told.join(roots(told), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
