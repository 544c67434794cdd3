"""The walk-forward as a stream: days of a chain arrive as shards, and each portfolio's book is kept as state.

A step runs two streams over what has arrived since the last one, and ends. The first takes each
shard's days, finds their candidate legs, adds the quotes of contracts that a portfolio may hold (those of this and all earlier
candidates), and writes the rows to a folder of its batch. The second groups these rows by scenario and fold;
each group's book is a value of Spark's state store, read and written once a batch, so a day's work doesn't grow with the
days before it. Both streams' checkpoints and the rows are in one shared folder, and a batch that was written
isn't written again, so a step that broke off is taken up where it was.

A day that arrives when a book has seen a later one can't change the books any more: its rows go to rejects, with
the batch they came in. Rows without a date do, too. Days must arrive whole. The days' watermark frees a
book once its fold's test window has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from strikeflow.plans import simulation as sim
from strikeflow.streaming.events import read_files

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "scenario string, gate string, fold_index int, date date, underlying double, `row` string, leg int, expiry date, strike double, option_type string, qty int, bid double, ask double, settle double, model_price double, max_risk double, note string, active boolean, test_end date, batch long"


class Books(StatefulProcessor):
    """A state machine for each scenario and fold, whose book is kept from batch to batch."""

    def __init__(self, named: dict[str, sim.Scenario], kinds: dict[str, sim.Strategy], fills: dict[str, sim.Fill]):
        self.named, self.kinds, self.fills = named, kinds, fills

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s = self.named[key[0]]
        machine = sim.Machine(s, int(key[1]), self.kinds[s.strategy], self.fills)
        if self.book.exists():
            machine.read(self.book.get()[0])
        else:
            own = next(rows)
            rows = iter([own, *rows])
            # a day later no row of the window can come
            self.handle.registerTimer(int(pd.Timestamp(own["test_end"].iloc[0]).timestamp() * 1000) + 1)
        out = machine.days(pd.concat(list(rows), ignore_index=True))
        self.book.update((machine.written(),))
        yield sim.framed(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.book.clear()
        yield sim.framed([])

    def close(self) -> None:
        pass


@contextmanager
def set_for(spark: SparkSession, **settings: str):
    """Settings that hold for a while."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


@dataclass
class Walk:
    """A walk-forward over shards of a chain (in folder source, as parquet with schema), all of whose tables are under folder: rows, rejects, result, checkpoints.

    folds: windows over dates that may be still to come. gates: (date, gate, active) for these dates.
    """

    spark: SparkSession
    source: str
    schema: StructType
    folder: str
    todo: list[sim.Scenario]
    folds: DataFrame
    gates: DataFrame | None = None
    strategies: dict[str, sim.Strategy] | None = None
    fills: dict[str, sim.Fill] | None = None

    def __post_init__(self):
        self.named = sim.by_name(self.todo)
        self.kinds = sim.STRATEGIES | (self.strategies or {})
        self.prices = sim.FILLS | (self.fills or {})

    def _seen(self, batch: int) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows").where(F.col("batch") < batch)

    def _take(self, shard: DataFrame, batch: int) -> None:
        """Writes the rows of a batch, and what is late."""
        to = f"{self.folder}/rows/batch={batch}"
        if _exists(self.spark, f"{to}/_SUCCESS"):
            return
        shard = shard.persist()
        try:
            known = _exists(self.spark, f"{self.folder}/rows")
            last = self._seen(batch).agg(F.max("date")).first()[0] if known else None
            late = F.col("date").isNull() if last is None else F.col("date").isNull() | (F.col("date") <= F.lit(last))
            shard.where(late).withColumn("taken_until", F.lit(last).cast("date")).write.mode("overwrite").parquet(f"{self.folder}/rejects/batch={batch}")
            own = shard.where(~late)
            days = sim.fold_days(own, self.folds).checkpoint()
            legs = sim.candidate_legs(own, self.todo, days, self.kinds)
            held = legs.select(*sim.HOLDER, *sim.CONTRACT)
            if known:
                held = held.unionByName(self._seen(batch).where("`row` = 'c'").select(*sim.HOLDER, *sim.CONTRACT))
            rows = sim.day_rows(own, self.todo, days, legs, held, self.gates)
            rows.join(self.folds.select("fold_index", "test_end"), "fold_index").withColumn("batch", F.lit(batch)).select(*(c.name for c in self._rows())).drop("batch").write.mode("overwrite").parquet(to)
        finally:
            shard.unpersist()

    def _rows(self) -> StructType:
        return self.spark.createDataFrame([], ROWS).schema

    def step(self) -> DataFrame:
        """Takes in what has arrived; the result so far (rows as simulation.OUT)."""
        read_files(self.spark, self.source, self.schema).writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.folder}/checkpoints/take").trigger(availableNow=True).start().awaitTermination()
        with set_for(self.spark, spark__sql__streaming__stateStore__providerClass=PROVIDER):
            # days that were taken in together come in order: a machine sorts the days of its batch
            rows = self.spark.readStream.schema(self._rows()).parquet(f"{self.folder}/rows").withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", "0 seconds")
            books = rows.groupBy("scenario", "fold_index").transformWithStateInPandas(Books(self.named, self.kinds, self.prices), outputStructType=self.spark.createDataFrame([], sim.OUT).schema, outputMode="append", timeMode="EventTime")
            books.writeStream.format("parquet").option("path", f"{self.folder}/result").option("checkpointLocation", f"{self.folder}/checkpoints/books").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return self.result()

    def result(self) -> DataFrame:
        return self.spark.read.schema(sim.OUT).parquet(f"{self.folder}/result")

    def rejects(self) -> DataFrame:
        """The rows that came too late or without a date, with the batch and the last day that a book had seen."""
        return self.spark.read.parquet(f"{self.folder}/rejects")
