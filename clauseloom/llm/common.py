"""Helpers that the numbered operators share: shared storage, components, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A folder of our own is set only where the session names none and runs on one machine, as in
    local tests; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="clauseloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Removes an execution's shuffle files when it ends, instead of when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions of frames that are made in here drop their shuffle files as they end.

    The setting has a default, which ``conf.get`` returns only if it is given no other one.
    """
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder, so a lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`settle` for wide or large rows: a compressed columnar table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("parquet.block.size", 16 << 20).parquet(path)  # smaller groups of rows held by writers and readers
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of :func:`stored` tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Texts that go to a Python worker at a time.
TEXTS = 1_000


def texts_of(df: DataFrame) -> DataFrame:
    """``df``, whose rows hold whole texts: at most TEXTS of them go to Python at a time.

    Spark's own default of 10,000 rows holds that many whole texts several times over.  A
    smaller setting of the session stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key, "10000"))
    if not 0 < now <= TEXTS:
        df.sparkSession.conf.set(key, TEXTS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable over undirected ``edges``.

    Every round takes the smallest label among neighbours and then jumps to the label's own
    label, so chains shrink geometrically.  Sums per node are combined before the shuffle and
    the joins stay plain equi-joins, which adaptive execution can split when a node is hot.
    Nodes without edges are not returned; an empty input gives an empty result.
    """
    pairs = edges.where(F.col(a) != F.col(b))
    both = settle(
        pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .unionByName(pairs.select(F.col(b).alias("src"), F.col(a).alias("dst")))
        .distinct()
    )
    labels = settle(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component"))
    )
    while True:
        seen = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(seen, "node").select("node", "component", F.least("component", "m").alias("low"))
        own = hooked.select(F.col("node").alias("at"), F.col("low").alias("lower"))
        step = settle(
            hooked.join(own, hooked.low == own["at"], "left").select(
                "node", F.least("low", "lower").alias("component"), (F.least("low", "lower") < F.col("component")).alias("moved")
            )
        )
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels


#: Bytes of rows that pandas sees at a time in :func:`map_slices`.
SLICE = 4 << 20


def _size(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row: exact for strings and binaries, the mean for other columns."""
    out = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        kind = c.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        else:
            out += c.nbytes // max(1, batch.num_rows)
    return out


def slices(batch: pa.RecordBatch, rows: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``size`` bytes, one row at least."""
    ends = np.cumsum(_size(batch))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 500) -> DataFrame:
    """mapInPandas for rows that hold whole texts or lists: pandas sees ``rows`` rows, or SLICE bytes, at a time."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (part.to_pandas() for b in batches for part in slices(b, rows))
        for out in run(frames):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)
        pa.default_memory_pool().release_unused()  # workers live on and serve other stages

    return texts_of(df).mapInArrow(sliced, schema)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup batches of rows sorted by ``keys`` so that no group is cut; only the last group waits."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = len(pdf) - int(last[::-1].argmin()) if not last.all() else 0
        same = bool(rest) and all(rest[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)
        if cut or not same:
            whole = [*rest, pdf.iloc[:cut]] if cut else rest
            rest = [pdf.iloc[cut:]]
            if whole:
                yield pd.concat(whole, ignore_index=True)
        else:
            rest.append(pdf)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def group_bounds(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the groups of rows sorted by ``keys``."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(pdf)))
