"""Correction lists and session stores as stateful streams.

A key's state holds, for each entry, the newest change seen, removals included, and the newest clear. Changes carry a running
number, and only newer ones count, so a stream in any order and any cut into batches leaves the same state: that of
``state.latest`` over the whole log. What comes out is a change feed: an entry's new value, or its removal.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmap.session import workers_see_package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lists(StatefulProcessor):
    """One scope's list: ``add``, ``edit``, ``remove`` of a key, ``clear`` of all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "entry string", "seq long, gone boolean")
        self.cleared = handle.getValueState("cleared", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        clear = self.cleared.get()[0] if self.cleared.exists() else None
        newest = clear
        changes: dict[str, tuple[int, bool, str | None]] = {}
        for part in rows:
            for seq, op, entry, value in part[["seq", "op", "entry", "value"]].itertuples(index=False):
                if op == "clear":
                    newest = seq if newest is None or seq > newest else newest
                elif entry not in changes or seq > changes[entry][0]:
                    changes[entry] = (seq, op == "remove", None if pd.isna(value) else value)
        out = []
        if newest != clear:
            self.cleared.update((newest,))
            for (entry,), (seq, gone) in list(self.entries.iterator()):
                if seq < newest:
                    if not gone:
                        out.append((key[0], entry, newest, True, None))
                    self.entries.removeKey((entry,))  # what is older than a clear is never asked for again
        for entry, (seq, gone, value) in changes.items():
            if newest is not None and seq <= newest:
                continue
            held = self.entries.getValue((entry,)) if self.entries.containsKey((entry,)) else None
            if held is None or seq > held[0]:
                self.entries.updateValue((entry,), (seq, gone))
                out.append((key[0], entry, seq, gone, None if gone else value))
        if out:
            yield pd.DataFrame(out, columns=["scope", "entry", "seq", "gone", "value"])

    def close(self) -> None:
        pass


def list_changes(log: DataFrame) -> DataFrame:
    """The change feed ``scope, entry, seq, gone, value`` of a stream ``scope, seq, op, entry, value``; output mode ``update``.

    ``seq`` tells a scope's changes apart. Rows without scope or number, and changes but clears without an entry, are left out.
    """
    spark = log.sparkSession
    workers_see_package(spark)
    spark.conf.set(_PROVIDER, _ROCKS)
    rows = log.select(F.col("scope").cast("string").alias("scope"), F.col("seq").cast("long").alias("seq"), "op", F.col("entry").cast("string").alias("entry"), F.col("value").cast("string").alias("value"))
    rows = rows.where("scope is not null and seq is not null and (op = 'clear' or entry is not null)")
    kind = "scope string, entry string, seq long, gone boolean, value string"
    return rows.groupBy("scope").transformWithStateInPandas(statefulProcessor=Lists(), outputStructType=kind, outputMode="Update", timeMode="None")


def folded(feed: DataFrame) -> DataFrame:
    """``scope, entry, seq, value``: the lists that a change feed leaves."""
    last = feed.groupBy("scope", "entry").agg(F.max(F.struct("seq", "gone", "value")).alias("m"))
    return last.where("not m.gone").select("scope", "entry", "m.seq", "m.value")


def run_to_end(feed: DataFrame, path: str) -> DataFrame:
    """The feed of a stream that is read to its present end, below the folder ``path``; a second run goes on from there."""
    spark: SparkSession = feed.sparkSession
    sink = feed.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/feed/batch={number}")  # a batch that runs again replaces itself

    sink.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(feed.schema).parquet(f"{path}/feed").select(*feed.columns)
