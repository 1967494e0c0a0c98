"""Structured Streaming forms: new files, new content, reissues, review state, counts, sessions, and a sink that adds nothing twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from clauseloom.operators import review
from clauseloom.sources import readers

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the documents in files that come into ``folder`` (the rows of :func:`readers.read_files`).

    With an ``availableNow`` trigger and a checkpoint, a run reads the files that no run before it has read.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", readers.WANTED).load(folder)
    return readers.read_contents(files)


def completed_sink(process: Callable[[DataFrame], dict[str, DataFrame]], folder: str, key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the tables ``process`` makes of a batch, and then that the batch is complete.

    A batch's rows go to a part of their own, which a repeated batch writes anew; the completion
    event, with the ``key`` of every row of the batch, comes last.  A batch that failed half-way
    is therefore done again in full, and one that is complete is not touched again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{folder}/completed/batch={number}"
        if _exists(spark, f"{done}/_SUCCESS"):
            return
        held = batch.persist()
        try:
            for name, rows in process(held).items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            held.select(key).distinct().withColumn("completed_at", F.current_timestamp()).write.mode("overwrite").parquet(done)
        finally:
            held.unpersist()

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def completed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the sink, without what batches left that are not complete."""
    try:
        done = spark.read.parquet(f"{folder}/completed").select("batch").distinct()
    except AnalysisException:  # nothing is complete
        return spark.read.parquet(f"{folder}/{name}").limit(0)
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(done), "batch", "left_semi").drop("batch")  # a row for each batch


def run_new(stream: DataFrame, process: Callable[[DataFrame], dict[str, DataFrame]], folder: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Read what is there now, write it by :func:`completed_sink` and stop."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(completed_sink(process, folder, key))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_content(stream: DataFrame, time_col: str = "arrived", delay: str = "7 days") -> DataFrame:
    """The first document of each content within the watermark."""
    hashed = stream.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["file_hash"])


class _Chain(StatefulProcessor):
    """The newest document of a file name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "doc_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = np.unique(np.concatenate([pdf["doc_id"].to_numpy(np.int64) for pdf in rows]))
        before = self.newest.get()[0] if self.newest.exists() else None
        ids = ids if before is None else ids[ids > before]
        if len(ids):
            self.newest.update((int(ids[-1]),))
        out = pd.DataFrame({"filename": key[0], "doc_id": ids, "supersedes": pd.array([before, *ids[:-1].tolist()][: len(ids)], dtype="Int64")})
        yield out[out["supersedes"].notna()]

    def close(self) -> None:
        pass


def reissues(stream: DataFrame) -> DataFrame:
    """Rows (filename, doc_id, supersedes) of documents that replace an earlier one of their name.

    ``stream`` has filename, doc_id, parent_id and status.  Only top-level documents that were ingested count.  The
    state is one id for each name, so a correction finds its predecessor however late it comes; an
    id that comes again or out of order replaces nothing.  The session needs the RocksDB state store.
    """
    able = stream.where("parent_id is null and status = 'ingested' and doc_id is not null").select("filename", "doc_id")
    return able.groupBy("filename").transformWithStateInPandas(_Chain(), "filename string, doc_id long, supersedes long", "append", "none")


def weekly_counts(events: DataFrame, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events by type in weeks that begin on Monday."""
    week = F.window(time_col, "7 days", "7 days", "4 days")
    return events.withWatermark(time_col, delay).groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    session = F.session_window(time_col, gap)
    return events.withWatermark(time_col, delay).groupBy(session.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def review_states(decisions: DataFrame) -> DataFrame:
    """The running status of each proposal from a stream of (proposal_id, seq, level, decision); a batch's events go by seq."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = review.STATUSES.index(state.get[0]) if state.exists else 0
        events = pd.concat(list(frames)).sort_values(["seq", "level", "decision"])
        to, _ = review.composed(np.array([0]), *review.moves(events["level"].to_numpy(), events["decision"].to_numpy()))
        status = review.STATUSES[to[0, at]]
        state.update((status,))
        yield pd.DataFrame({"proposal_id": [key[0]], "status": [status]})

    return decisions.groupBy("proposal_id").applyInPandasWithState(run, "proposal_id long, status string", "status string", "update", GroupStateTimeout.NoTimeout)
