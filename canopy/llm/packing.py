"""Packing documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm import common, tokens

#: Tokens of a sequence.
CAPACITY = 2048
#: The id after each document.
END = 1


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n tokens begin: whole sequences, then the rest."""
    return list(range(0, n, capacity))


def shortest_pack_first(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, how many sequences) that hold counts[n] pieces of each length n.

    Lengths are placed longest first, each into the emptiest packs that have room for it, as many
    as are alike at once; the work depends on the capacity, not on the number of documents.
    """
    free: dict[int, list[list]] = {}
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            room = max((r for r, packs in free.items() if packs), default=0)
            if room >= n:
                pack = free[room][-1]
                take = min(left, pack[1])
                pack[1] -= take
                if not pack[1]:
                    free[room].pop()
                lengths = pack[0]
            else:
                take, room, lengths = left, capacity, ()
            free.setdefault(room - n, []).append([(*lengths, n), take])
            left -= take
    return [(lengths, k) for room in sorted(free) for lengths, k in free[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length, ranges of ranks and what they get: (first row of each length, rank from, sequence of that rank, offset)."""
    rows: list[tuple[int, int, int, int]] = []
    rank = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, k in patterns:
        at = 0
        for n in lengths:
            rows.append((n, int(rank[n]), sequence, at))
            rank[n] += k
            at += n
        sequence += k
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return np.searchsorted(table[:, 0], np.arange(capacity + 2)), table[:, 1], table[:, 2], table[:, 3]


def cut_documents(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens. Null texts count as empty: one piece of the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.lent(path) as enc:
            for b in common.pieces(batches, "text", 2 << 20):
                ids, off = enc.encode(b.column(1).to_pylist())
                out: list[list[int]] = [[], [], [], [], []]
                for i in range(b.num_rows):
                    x = np.append(ids[off[i] : off[i + 1]], END).astype("<u4")
                    starts = cut_points(len(x), capacity)
                    for a, z in zip(starts, [*starts[1:], len(x)], strict=True):
                        for col, v in zip(out, (i, a, z - a, zlib.crc32(x[a:z].tobytes()), len(x)), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents of df into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Pieces are counted by length (a histogram of `capacity` numbers, all that the driver sees), the
    patterns are found from that, and each piece gets the place that its rank among the pieces of
    its length has. Ranks come from counts of (length, share), so that a length which a third of
    the pieces have is spread over many tasks. Null texts count as empty, a null id is kept, each
    repeated row is packed anew, an empty table gives an empty result, other columns are ignored.
    """
    spark = df.sparkSession
    cut = common.cut(cut_documents(df, path, capacity, id_col, text_col))
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in cut.groupBy("length").count().collect():
        counts[n] = k
    patterns = shortest_pack_first(counts, capacity)
    first, rank_from, seq_from, at = slots(patterns, capacity)
    shares = int(min(1 << 20, max(16, counts.max() // 5000)))
    dealt = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)))
    before = (
        dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "share", F.coalesce("before", F.lit(0)).alias("before"))
    )
    local = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = dealt.withColumn("local", local).join(before, ["length", "share"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("rank"))
    tables = spark.sparkContext.broadcast((first, rank_from, seq_from, at))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rank_from, seq_from, at = tables.value
        for b in batches:
            n, rank = (b.column(i).to_numpy() for i in (2, 5))
            order = np.argsort(n, kind="stable")
            row = np.empty(len(n), np.int64)
            lengths, begins = np.unique(n[order], return_index=True)
            for x, own in zip(lengths, np.split(order, begins[1:]), strict=True) if len(n) else ():
                lo, hi = first[x], first[x + 1]
                row[own] = lo + np.searchsorted(rank_from[lo:hi], rank[own], side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq_from[row] + rank - rank_from[row]), pa.array(at[row])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
