"""A stateful stream over update events: the newest version of each document and the versions that no event has brought."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "version bigint, hash string, edges array<bigint>, step bigint"
TRACKED = "doc_id bigint, version bigint, hash string, edges array<bigint>, step bigint"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(edges: list[int], versions: list[int]) -> list[int]:
    """Ranges of versions, as first, last, first, last.., with more versions; repeated ones change nothing."""
    points = sorted([*((edges[k], edges[k + 1]) for k in range(0, len(edges), 2)), *((v, v) for v in versions)])
    out: list[int] = []
    for first, last in points:
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


class Tracker(StatefulProcessor):
    """State of a document: its newest version with its hash, and the ranges of versions that have come, in whatever order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("document", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, hash_, edges, step = self.state.get() if self.state.exists() else (None, None, [], 0)
        edges = [int(x) for x in edges]
        for part in rows:
            part = part[part["version"].notna()]
            edges = merged(edges, [int(v) for v in part["version"]])
            for v, h in zip(part["version"], part["hash"], strict=True):
                if version is None or (int(v), h or "") > (version, hash_ or ""):
                    version, hash_ = int(v), h
        if version is None:
            return
        step += 1
        self.state.update((version, hash_, edges, step))
        yield pd.DataFrame({"doc_id": [int(key[0])], "version": [version], "hash": [hash_], "edges": [edges], "step": [step]})

    def close(self) -> None:
        pass


def start(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there and stop; running it again goes on from the checkpoint's state.

    Each batch's documents go to a folder of their own, so that a repeated batch changes nothing. Events of a null doc_id
    or version are left out; repeated, late and disordered ones are welcome. The session's state store
    must keep typed state: RocksDB serves this stream where the session has another. There are no timers: with them a run
    over what is there would never end.
    """
    spark = events.sparkSession
    rows = events.where("doc_id is not null and version is not null").select("doc_id", "version", "hash")
    tracked = rows.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Tracker(), outputStructType=TRACKED, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = tracked.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if "RocksDB" not in (before or ""):
        spark.conf.set(name, _PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def tracked(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each document: doc_id, version, hash, edges, step."""
    rows = spark.read.schema(TRACKED).parquet(path)
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("version", "hash", "edges", "step"), "step").alias("s")).select("doc_id", "s.*")


def gaps(states: DataFrame) -> DataFrame:
    """doc_id, after, before: versions that no event brought, between two that came."""
    inner = F.expr("transform(sequence(1, size(edges) div 2 - 1), k -> struct(edges[2 * k - 1] as after, edges[2 * k] as before))")
    return states.where("size(edges) > 2").select("doc_id", F.explode(inner).alias("g")).select("doc_id", "g.after", "g.before")
