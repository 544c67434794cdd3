"""Small helpers shared by operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.session import checkpoint_dir, scratch


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Spans of at most capacity; only the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    edges = [*([0] if first else []), *range(first, length + 1, capacity)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def free(columns: list[str], name: str) -> str:
    """name, followed by as many underscores as it takes to be none of columns (which Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(rows: DataFrame, group: int | None = None) -> DataFrame:
    """rows, written as Parquet to the shared folder and read from there: like checkpoint(), but compressed and read by column. For rows of megabytes, group: bytes of a row group, which tasks that write or read hold at once (Parquet else looks at their size after 100 rows only)."""
    folder = scratch(rows.sparkSession, "rows")
    rows.write.options(**{"parquet.block.size": group, "parquet.page.size.row.check.min": 1} if group else {}).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def bucketed(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """rows, written to a folder under the shared one in as many buckets of key as the session shuffles to, and read from there: joins and groups on key leave these rows where they are and shuffle the other side only. The table's name leaves the catalog at once, its files stay."""
    spark, name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", folder).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder that no later step reads, not even to make up for a lost executor."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(rows: DataFrame) -> DataFrame:
    """rows (a checkpoint or a written table), once Spark may have dropped what they were made from: shuffle files go when the driver's JVM finds that nothing refers to them, which a driver with memory to spare seldom looks for."""
    rows.sparkSession.sparkContext._jvm.System.gc()
    return rows


#: The most rows that are broadcast; beyond it both sides of a join are shuffled. The driver takes about three times a broadcast table's size, beside its heap's floor.
FEW = 1 << 16
#: Bits of a bitmap for each of its keys, and the fewest and most of a bitmap: its words that aren't zero pass through the driver.
SPREAD, BITS = 16, (1 << 12, 1 << 24)


def small(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """rows (a checkpoint), to be broadcast where they are limit (FEW) at most."""
    return F.broadcast(rows) if rows.count() <= (FEW if limit is None else limit) else rows


def bitmap(keys: DataFrame) -> np.ndarray:
    """Of a checkpoint of distinct hashes (its one column), a bit for each value that they have in their low bits.

    What has no bit is none of keys; so a table can be thinned out before it is joined with more keys than may be broadcast. With
    more keys than the longest bitmap is made for, more rows are left, and no fewer.
    """
    n = min(max(1 << (SPREAD * keys.count()).bit_length(), BITS[0]), BITS[1])
    low = F.col(keys.columns[0]).bitwiseAND(F.lit(n - 1))
    words = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(n >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of keys (64 bits) have their bit in a bitmap."""
    low = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


#: The most classes that a sample is spread over, the most frequent ones.
CLASSES = 1000


def sample(docs: DataFrame, limit: int, max_bytes: int = 128 << 20, *, labels: DataFrame | None = None, stratified: bool = False, classes: int = CLASSES) -> pa.Table:
    """To the driver: about limit of the rows (doc_id, text, label), whole texts of about max_bytes in all. labels (doc_id, label), one for each doc_id, may stand in for the column.

    A bounded sample to fit a classifier on, spread over the whole table: a row is taken
    if a hash of its doc_id and text is under a threshold, so nothing is sorted, and
    the same rows are taken however they are partitioned. Equal rows count once. Stratified,
    each of the labels (the `classes` most frequent ones; rows of others are left out) has its own threshold, so that rare ones get an even share.
    Rows with a null label are left out, and texts of over max_bytes / 16, which no sample of that size can hold
    fairly. The table is ordered by the hash. Only lengths and hashes meet the labels before the threshold is known.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.col("text").cast("string")), 11) / float(1 << 53)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), *([] if labels is not None else [F.col("label").cast("string").alias("label")]))
    own = own.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes // 16)
    named = labels.select("doc_id", F.col("label").cast("string").alias("label")) if labels is not None else None
    put = lambda df: (df.join(named, "doc_id") if named is not None else df).where("label is not null")
    brief = put(own.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), *([] if named is not None else ["label"])))
    sizes = brief.groupBy(F.col("label") if stratified else F.lit("").alias("label")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("n"), "label").limit(classes).collect()
    sizes.sort(key=lambda r: r["label"])
    share = shares([r["n"] for r in sizes], limit)
    size = [max(1, r["bytes"]) * s for r, s in zip(sizes, share, strict=True)]
    cut = [s * min(1.0, b / x) if x else s for s, x, b in zip(share, size, shares([int(x) for x in size], max_bytes, part=False), strict=True)]
    taken = put(own.where(F.col("h") < max([0.0, *cut])))
    if stratified:
        # a row for each class
        least = docs.sparkSession.createDataFrame([(r["label"], float(c)) for r, c in zip(sizes, cut, strict=True)], "label string, least double")
        taken = taken.join(F.broadcast(least), "label").where(F.col("h") < F.col("least"))
    return taken.select("doc_id", "text", "label", "h").distinct().toArrow().sort_by("h")


def shares(counts: list[int], limit: float, part: bool = True) -> list[float]:
    """An even share of limit for each class, what small classes leave going to larger ones; part: as a part of each class's count."""
    out, left = [0.0] * len(counts), float(limit)
    order = sorted(range(len(counts)), key=counts.__getitem__)
    for k, i in enumerate(order):
        out[i] = min(float(counts[i]), left / (len(order) - k))
        left -= out[i]
    return [x / n if n else 0.0 for x, n in zip(out, counts, strict=True)] if part else out
