"""A training-data pipeline over documents.

STAGES are applied in order, each to all that its predecessor kept: toxic
documents go, repeated lines go, one document of each group of near-duplicates
stays (the one with the smallest doc_id), personal data is replaced by its kind,
and what remains is packed into sequences. All stages but the last return the
columns of documents, whatever further ones there are, under any name. Of repeated rows one stays (as of any
near-duplicates; ties in doc_id go to the smaller hash of the text), and a row without doc_id stays
where it is no near-duplicate. A null text passes all stages as an empty one; of all texts without
words one stays. An empty table gives no rows. No stage samples, caps or cuts texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import line_dedup, near, packing, pii, shared, toxicity
from strikeflow.llm import textbytes as tb


def _rewritten(docs: DataFrame, change, shipped) -> DataFrame:
    """docs with text replaced by change(text, shipped value), and n_chars counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shipped.value
        for batch in batches:
            for rows in tb.pieces(batch):
                texts = [None if t is None else change(t, value) for t in rows.column("text").to_pylist()]
                new = {"text": pa.array(texts, pa.string())}
                if "n_chars" in rows.schema.names:
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], rows.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(n, rows.column(n)) for n in rows.schema.names], names=rows.schema.names)

    return docs.mapInArrow(run, docs.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones, doesn't call toxic."""
    model = spark.sparkContext.broadcast(toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(False)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tb.pieces(batch, size=tb.SLICE):
                score, *_ = model.value(rows.column("text"))
                yield rows.filter(pa.array(score < toxicity.THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those that lose all their lines but blank ones go."""
    out = line_dedup.dedup(docs)
    dropped = F.col(shared.free(docs.columns, "n_dropped"))
    return out.where((dropped == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (5-word shingles, Jaccard similarity of 0.8 or more): the smallest doc_id's, without doc_id only where none has one."""
    null, id_, key = (shared.free(docs.columns, f"__{x}") for x in ("null", "id", "key"))
    name = [null, id_, key]
    rows = near.components(docs).groupBy("component", F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("text_key").alias(key)).agg(F.count("*").alias("n")).checkpoint()
    # most documents are alone in their component and meet nothing: only those of the others are named
    best = rows.groupBy("component").agg(F.min(F.struct(*name)).alias("best"), F.count("*").alias("of")).where("of > 1").drop("of").checkpoint()
    gone = rows.join(shared.small(best), "component").where(F.struct(*name) != F.col("best")).select(*name).checkpoint()
    again = rows.where("n > 1").select(*name).checkpoint()
    keyed = docs.withColumns({null: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), key: F.xxhash64(F.col("text").cast("string"))})
    kept = keyed.join(shared.small(gone), name, "left_anti")
    # only repeated rows have to meet
    repeated = shared.small(again)
    out = kept.join(repeated, name, "left_anti").unionByName(kept.join(repeated, name, "left_semi").dropDuplicates(name))
    return out.select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return _rewritten(docs, lambda text, field: pii.redact(text, pii.find(text, field)[1]), spark.sparkContext.broadcast(pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("pii", redact_pii),
    ("best_fit_packing", pack),
]

#: Models are trained in two stages; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir, each stage's result written and read again."""
    folder = shared.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
