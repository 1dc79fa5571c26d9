"""What the operators share: cutting lineage, sizing buckets, Arrow helpers and connected components."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there.

    The folder is the one that ``spark.checkpoint.dir`` names. Where none is set, a local session
    (as in tests) takes a temporary one, and a cluster one in the warehouse, which all machines share.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp(prefix="canopy-checkpoint-") if sc.master.startswith("local[") or sc.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/canopy-checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Remove the files of a frame made by `cut`; only once nothing reads it any more."""
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker is used again for other tasks; what this one took goes back at its end."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def text_total(df: DataFrame, text_col: str) -> int:
    """The bytes of all texts, counted: an optimizer's estimate multiplies the sides of joins that df comes from."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def buckets(total: int, bytes_each: int, least: int = 32, most: int = 1 << 20) -> int:
    """How many hash buckets to deal so many bytes into: a power of two that grows with the input."""
    return int(min(most, max(least, 2 ** math.ceil(math.log2(max(total / bytes_each, 1))))))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of `column`, a single row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty: (all bytes, offsets)."""
    col = pa.array(col.fill_null(""), pa.large_binary()) if not isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_large_binary(col.type):
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        return data[off[0] : off[-1]], off - off[0]
    raise TypeError(col.type)


#: A table of at most so many rows of a few numbers each is broadcast.
FEW = 500_000
#: A key is hot if it has more than this part of all rows; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 512


def lookup(rows: DataFrame, table: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """rows with the columns of `table`, which has each key once, or nulls: a left join on `key` that no hot key slows down.

    A table of at most `few` rows, counted first, is broadcast. Of a larger one only the rows of hot keys are,
    less than 1 / HOT_SHARE of them; the others meet by a shuffle. Both are read more than once, so
    they should be written already, or be cheap.
    """
    if table.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).count()
    total = rows.count()
    hot = [r[0] for r in counts.where((F.col("count") > total * HOT_SHARE) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    hots = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    few = F.broadcast(table.join(hots, key, "left_semi"))
    return rows.join(hots, key, "left_semi").join(few, key, "left").unionByName(rows.join(hots, key, "left_anti").join(table, key, "left"))


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): rows (id, root), root the smallest id.

    Null ends are dropped, loops and repeated edges do no harm. Each round takes the smallest
    root around an id and then the root of that root; counts of changed rows and the ids of hubs, less
    than 1 / HOT_SHARE, are all that reaches the driver. Each round's labels are checkpointed. Edges of
    hubs do not move: the hubs' few labels are broadcast to them.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    total = both.count()
    hubs = [r[0] for r in both.groupBy("a").count().where(F.col("count") > max(total * HOT_SHARE, FEW * HOT_SHARE)).select("a").collect()]
    plain, of_hubs = (both.where(~F.col("a").isin(hubs)), both.where(F.col("a").isin(hubs))) if hubs else (both, None)
    for _ in range(most_rounds):
        labels = held.select("id", "root")
        ends = labels.select(F.col("id").alias("a"), "root")
        met = plain.join(ends, "a").select("b", "root")
        if hubs:
            met = met.unionByName(of_hubs.join(F.broadcast(ends.where(F.col("a").isin(hubs))), "a").select("b", "root"))
        near = met.groupBy(F.col("b").alias("id")).agg(F.min("root").alias("near"))
        step = cut(labels.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("low")))
        # for each root the smallest root around its members, or its own: a hub's members all look there
        goal = step.groupBy("root").agg(F.min("low").alias("goal")).unionByName(labels.select(F.col("id").alias("root"), F.col("root").alias("goal")))
        goal = cut(goal.groupBy("root").agg(F.min("goal").alias("goal")))
        new = cut(lookup(step, goal, "root").select("id", F.least("low", F.coalesce("goal", "low")).alias("root"), F.col("root").alias("was")))
        changed = new.where("root <> was").limit(1).count()
        for done in (held, step, goal):
            drop(done)
        held = new
        if not changed:
            drop(both)
            return held.select("id", "root")
    raise RuntimeError("components did not settle")
