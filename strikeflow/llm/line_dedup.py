"""Line de-duplication by a segment-partition edit join, in DataFrame functions only.

A line is dropped if an earlier line of the table, in the order of doc_id, a hash of
the text, and position, equals it, or if it has MIN_CHARS characters or more and is
within EDITS edits of it. Blank lines are always kept.

Equal lines form a class with its first occurrence. Each class's line is split
into EDITS + 1 segments. If two lines are within EDITS edits, one segment of the
shorter stands unchanged in the longer, at a place that its length and the
segment's number narrow down to a few. Own keys are the hashes of a line's
segments, probe keys those of the substrings at these places for each shorter length
that another line may have. Keys are counted first; only keys that several classes
share are joined, on the hash. Letter counts, which an edit changes by two at
most, and then banded bit-parallel edit distance verify the pairs.

A key that more than BUCKET classes share (the lines of a template) isn't paired, at
one edit: what the key leaves open is split in two, one half of which stands
unchanged as well, and the classes are dealt out again by all but the other half, until
buckets are small or one character is left open. Lines of equal length that differ in
this one character are all within an edit of each other, so the earliest stands for
all; a longer line meets those whose character it holds. So rows grow with the
number of lines times the logarithm of their length, and no pair is lost. With
more edits, all pairs of a bucket are verified.

Results: texts are split at line feeds and kept lines joined by them. A null text
stays null with no lines. Rows with a null doc_id are returned unchanged and
count for no other. Rows with one doc_id and different texts are documents of their
own; equal rows count as one document and are returned each. An empty
table gives no rows. Lines and texts of any length are compared whole. Columns
other than text keep their values; n_chars, if present, is counted anew. The
counts are added as n_lines and n_dropped, with underscores behind where docs has such a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared

EDITS = 1
MIN_CHARS = 40
LETTERS = "entiaros"
#: The most classes of a key that are paired.
BUCKET = 32


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each segment; later ones are longer by one where the length doesn't divide."""
    n = edits + 1
    base, extra = F.floor(length / n).cast("int"), length % n
    out = []
    for i in range(n):
        longer = F.greatest(F.lit(i) - (n - extra), F.lit(0))
        out.append((base * i + longer + 1, base + F.when(n - extra <= i, 1).otherwise(0)))
    return out


def segment_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """(key, own) of a line: its own segments, and the substrings that may equal a segment of a line of this length or up to edits less."""
    out = []
    for less in range(edits + 1):
        other = length - less
        for i, (start, size) in enumerate(segments(other, edits)):
            # at most i edits stand before the segment and edits - i after it
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                own = 1 if less == shift == 0 else 0
                out.append(F.struct(F.xxhash64(F.substring(line, start + shift, size), other, F.lit(i)).alias("key"), F.lit(own).alias("own"), F.lit(less).alias("less"), F.lit(edits - i).alias("open")))
    return out


def edge(length: Column, k: Column, parts: Column) -> Column:
    """Where part k of so many parts of a line begins, from 0."""
    return F.floor(length.cast("long") * k / parts).cast("int")


def open_key(row: Column) -> Column:
    """The hash of a line without its open part. row: line, length (of the own lines), less (what this line is longer by), parts, open."""
    start, end = (edge(row["length"], row["open"] + k, row["parts"]) for k in (0, 1))
    return F.xxhash64(F.substring(row["line"], F.lit(1), start), F.substring(row["line"], end + row["less"] + 1, F.length(row["line"])), row["length"], row["parts"], row["open"])


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS, a byte each."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(255), 8 * k))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound of how far letter counts are apart."""
    total = None
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftrightunsigned(a, 8 * k).bitwiseAND(255) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(255))
        d = F.least(d, 256 - d)
        total = d if total is None else total + d
    return total


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings, both longer than edits, are within so many edits: bit-parallel over a band of 2 * edits + 1 diagonals."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    inv = lambda x: F.bitwise_not(x).bitwiseAND(full)
    num = lambda x: F.lit(x).cast("long")

    def run(pair: Column) -> Column:
        s, t = pair["s"], pair["t"]
        m, n = F.size(s), F.size(t)

        def step(state: Column, i: Column) -> Column:
            match = num(0)
            for k in range(width):
                at = i - edits + k  # row of the longer string at bit k
                match = match + F.when((at >= 0) & (at < m) & (F.get(s, at) == F.get(t, i)), num(1 << k)).otherwise(num(0))
            vp, vn = state["vp"], state["vn"]
            diagonal = lambda x: (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full)

            def rest(d0: Column) -> Column:
                def close(h: Column) -> Column:
                    hp, hn = h["p"], h["n"]
                    low = F.shiftrightunsigned(d0, 1)
                    mask = F.when(i < m - edits, num(0)).otherwise(F.call_function("shiftleft", num(1), F.greatest(num(0).cast("int"), F.lit(width - 2) - (i - (m - edits)))))
                    moved = F.when(i < m - edits, F.when(d0.bitwiseAND(1 << (width - 1)) == 0, 1).otherwise(0)).otherwise(F.when(hp.bitwiseAND(mask) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(mask) != 0, 1).otherwise(0))
                    return F.struct(hn.bitwiseOR(inv(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"), (state["d"] + moved).alias("d"))

                return let(F.struct(vn.bitwiseOR(inv(d0.bitwiseOR(vp))).alias("p"), d0.bitwiseAND(vp).alias("n")), close)

            return let(match, lambda x: let(diagonal(x), rest))

        start = F.struct(num(full - ((1 << edits) - 1)).alias("vp"), num(0).alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda x: x["d"] <= edits)

    long_first = F.length(a) >= F.length(b)
    chars = lambda x: F.split(x, "")
    told = let(F.struct(F.when(long_first, chars(a)).otherwise(chars(b)).alias("s"), F.when(long_first, chars(b)).otherwise(chars(a)).alias("t")), run)
    return (F.abs(F.length(a) - F.length(b)) <= edits) & told


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """The lines of at least min_chars characters that aren't blank: their place (doc_id, tie, pos) and hash."""
    text = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("tie"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return text.where((F.length("line") >= min_chars) & (F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "")).withColumn("h", F.xxhash64("line"))


def classes_of(lines: DataFrame, min_chars: int) -> DataFrame:
    """(h, first, n, line): each distinct line, its first occurrence and how many there are; line: null if under min_chars."""
    line = F.when(F.length("line") >= min_chars, F.col("line"))
    return lines.select("h", F.struct("doc_id", "tie", "pos").alias("at"), line.alias("line")).groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.any_value("line").alias("line"))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, n, low, high): keys of more than one class, one of them with the key as its own; low and high are their least and greatest hashes."""
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("own").alias("n_own"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1 and n_own > 0").select("key", "n", "low", "high").checkpoint()


def paired(members: DataFrame) -> DataFrame:
    """(a, b): the pairs of members (key, h, own) of a key, one with the key as its own."""
    own = members.where("own = 1").select("key", F.col("h").alias("a"))
    return own.join(members.select("key", F.col("h").alias("b"), "own"), "key").where("a <> b and (own = 0 or a < b)").select("a", "b")


def last_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): links of members (key, h, own, first, line, length, less, parts, open) whose open part is a character or none. Of the own lines of a key, which are all near each other, each links to the earliest; a longer line links to the own line with one of the characters that it has there."""
    start, end = (edge(F.col("length"), F.col("open") + k, F.col("parts")) for k in (0, 1))
    part = F.substring(F.col("line"), start + 1, end - start + F.col("less"))
    lead = rows.where("own = 1").groupBy("key").agg(F.min_by("h", "first").alias("a"))
    stars = rows.where("own = 1").join(lead, "key").where("a <> h").select("a", F.col("h").alias("b"))
    own = rows.where("own = 1").select("key", part.alias("c"), F.col("h").alias("a"))
    letters = F.when(end == start, F.array(F.lit(""))).otherwise(F.array_distinct(F.split(part, "")))
    return stars.unionAll(rows.where("own = 0").select("key", F.col("h").alias("b"), F.explode(letters).alias("c")).join(own, ["key", "c"]).select("a", "b"))


def candidates(classes: DataFrame, edits: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): hashes of classes (h, first, line) that may be within edits of each other."""
    keyed = classes.select("h", F.explode(F.array(*segment_keys(F.col("line"), F.length("line"), edits))).alias("k")).select("h", "k.*")
    found = shared.freed(shared_keys(keyed))
    out = [found.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).where("a <> b")]
    members = shared.freed(keyed.hint("merge").join(found.where("n > 2").select("key", "n"), "key").checkpoint())
    if edits > 1:
        return out[0].unionAll(paired(members))
    out.append(paired(members.where(F.col("n") <= bucket)))
    rows, parts = members.where(F.col("n") > bucket).select("h", "own", "less", "open"), edits + 1
    while rows.limit(1).count():
        # the open part of a crowded key in two: classes are dealt out by all but one half
        parts *= 2
        lines = rows.repartition("h").distinct().join(classes.select("h", "first", "line"), "h")
        halves = F.explode(F.array(F.col("open") * 2, F.col("open") * 2 + 1))
        rows = lines.select("h", "first", "line", "own", "less", (F.length("line") - F.col("less")).alias("length"), F.lit(parts).alias("parts"), halves.alias("open"))
        rows = rows.withColumn("key", open_key(F.struct("line", "length", "less", "parts", "open"))).checkpoint()
        rows = rows.join(shared_keys(rows).select("key", "n"), "key").withColumn("wide", edge(F.col("length"), F.col("open") + 1, F.col("parts")) - edge(F.col("length"), F.col("open"), F.col("parts"))).checkpoint()
        out.append(paired(rows.where(F.col("n") <= bucket)))
        crowded = rows.where(F.col("n") > bucket)
        out.append(last_pairs(crowded.where("wide <= 1")))
        rows = crowded.where("wide > 1").select("h", "own", "less", "open")
    return reduce(DataFrame.unionAll, out)


def near_pairs(classes: DataFrame, edits: int, bucket: int = BUCKET) -> DataFrame:
    """(later, earlier): hashes of classes within edits of each other, by their first occurrence; of those that equal-length lines of a template have, the earliest at least."""
    pairs = candidates(classes, edits, bucket).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    shared.freed(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    met = classes.join(ends, "h", "left_semi").select("h", "first", "line", letter_counts(F.col("line")).alias("letters"))
    side = lambda name: met.select(*(F.col(c).alias(name if c == "h" else f"{c}_{name}") for c in met.columns))
    told = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").where(F.when(counts_apart(F.col("letters_a"), F.col("letters_b")) <= 2 * edits, within(F.col("line_a"), F.col("line_b"), edits)).otherwise(False))
    a_first = F.col("first_a") < F.col("first_b")
    return told.select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(a_first, F.col("first_a")).otherwise(F.col("first_b")).alias("earlier"))


def dropped_lines(docs: DataFrame, *, edits: int = EDITS, min_chars: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, tie, pos, near): the places of the lines to drop; near: for want of an equal earlier line, one within edits.

    Lines under min_chars are kept; without it only blank ones are, and MIN_CHARS bounds the edit join.
    """
    folder = shared.scratch(docs.sparkSession, "classes")
    lines = lines_of(docs, 1 if min_chars is None else min_chars)
    classes = shared.freed(shared.bucketed(classes_of(lines, MIN_CHARS if min_chars is None else min_chars), "h", folder))  # what joins them comes to their buckets, so their lines are shuffled once
    near = near_pairs(classes.where("line is not null").select("h", "first", "line"), edits, bucket).groupBy(F.col("later").alias("h")).agg(F.min("earlier").alias("earlier"))
    told = classes.select("h", "first", "n").join(near, "h", "left").where("n > 1 or earlier is not null").select("h", "first", F.col("earlier").isNotNull().alias("near")).checkpoint()
    shared.removed(docs.sparkSession, folder)
    shared.freed(told)
    # both sides of this join come straight from a shuffle, so that Spark can split a line that many documents share
    hit = lines.select("doc_id", "tie", "pos", "h").hint("merge").join(told, "h")
    return hit.where(F.col("near") | (F.struct("doc_id", "tie", "pos") != F.col("first"))).select("doc_id", "tie", "pos", "near").distinct()


def dedup(docs: DataFrame, *, edits: int = EDITS, min_chars: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text, ...) with the kept lines as text, and n_lines and n_dropped added. min_chars as for dropped_lines."""
    doc, tie, gone = (shared.free(docs.columns, f"__{x}") for x in ("doc", "tie", "gone"))
    n_lines, n_dropped = (shared.free(docs.columns, x) for x in ("n_lines", "n_dropped"))
    text = F.col("text").cast("string")
    drops = dropped_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), edits=edits, min_chars=min_chars, bucket=bucket)
    per = drops.groupBy(F.col("doc_id").alias(doc), F.col("tie").alias(tie)).agg(F.sort_array(F.collect_list("pos")).alias(gone))

    def kept(lines: Column) -> Column:
        d = F.col(gone)
        n = F.size(d)
        begin = lambda k: F.when(k > 0, F.get(d, k - 1) + 1).otherwise(0)
        end = lambda k: F.when(k < n, F.get(d, k)).otherwise(F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k)))), "\n")

    joined = docs.join(per.hint("merge"), (docs["doc_id"].cast("long") == per[doc]) & (F.xxhash64(docs["text"].cast("string")) == per[tie]), "left")  # texts are shuffled: what is dropped has no size bound
    new = F.when(F.col(gone).isNull(), text).otherwise(let(F.split(text, "\n"), kept))
    count = lambda x: F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    out = joined.select(*((new if c == "text" else F.col(c)).alias(c) for c in docs.columns), count(F.split(text, "\n")).alias(n_lines), count(F.col(gone)).alias(n_dropped))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
