"""Embedding near-dedup: collisions of many one-dimensional projections are counted, pairs with enough of them verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from canopy.llm import common

COSINE = 0.95
#: Projections, the share of pairs at the threshold that one window holds, and the recall that the count is calibrated to.
PROJECTIONS, WINDOW_SHARE, RECALL = 16, 0.95, 0.9995
#: Different vectors in a block of the sorted first projection.
BLOCK = 2048
#: Quantised steps in a window.
STEPS = 8
#: Bytes of vectors in a partition of blocks; a task holds two partitions.
PARTITION = 32 << 20
#: Rows of links that a task holds before it sums them up.
HELD = 1 << 20


def quantile(share: float) -> float:
    """z with P(|N(0, 1)| <= z) = share."""
    lo, hi = 0.0, 10.0
    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if math.erf(z / math.sqrt(2)) < share else (lo, z)
    return lo


def least_count(m: int, p: float, recall: float) -> int:
    """The largest count that m windows with probability p each reach with probability `recall`."""
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, m))


def as_matrix(raw: pa.Buffer | bytes, n: int, kind: str) -> np.ndarray:
    """n unit vectors in double precision."""
    x = np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(col: pa.Array, kind: str) -> tuple[list[bytes | None], np.ndarray]:
    """The bytes of each vector, None where it can link with nothing, and its place on the first projection."""
    raw: list[bytes | None] = [None] * len(col)
    place = np.zeros(len(col))
    begins, sizes = col.offsets.to_numpy()[:-1], pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    values = pc.fill_null(col.values, math.nan).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = values[begins[rows][:, None] + np.arange(size)] + 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            square = (x * x).sum(1)
        ok = np.isfinite(x).all(1) & (square > 0) & (square < math.inf)
        rows, x = rows[ok], x[ok]
        place[rows] = x @ directions(size, PROJECTIONS)[:, 0] / np.sqrt(square[ok])
        for r, v in zip(rows, x.astype(kind), strict=True):
            raw[r] = v.tobytes()
    return raw, place


def neighbours(bounds: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each block between sorted bounds the first and the last block that come within `reach` of it."""
    edges = np.concatenate([[-math.inf], bounds, [math.inf]])
    last = np.searchsorted(edges[:-1], edges[1:] + reach, side="right") - 1
    # read off the same comparisons, so that both blocks of a pair name each other
    return np.searchsorted(last, np.arange(len(last)), side="left"), last


def count_links(x: np.ndarray, y: np.ndarray, cosine: float, m: int, wide: float, least: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each vector of x those of y that link with it: query-centred windows over all projections, then exact cosines."""
    turn = directions(x.shape[1], m)
    q = lambda v: np.clip(np.rint(v @ turn * (STEPS / wide)), -59, 59).astype(np.int8)
    a, b = q(x) + np.int8(STEPS), np.ascontiguousarray(q(y).T)
    # single precision is off by less than this; only what it leaves open needs double
    near, x32, y32 = cosine - 1e-5 - 1e-6 * x.shape[1], x.astype(np.float32), y.T.astype(np.float32)
    for at in range(0, len(x), rows):
        part = a[at : at + rows]
        hits = np.zeros((len(part), len(y)), np.uint8)
        for k in range(m):
            hits += (part[:, k : k + 1] - b[k][None, :]).view(np.uint8) <= 2 * STEPS
        often = hits >= least
        if np.count_nonzero(often) > hits.size // 1000:
            often &= x32[at : at + rows] @ y32 >= near
        i, j = np.divmod(np.flatnonzero(often), len(y))
        if len(i) > hits.size // 50:
            i, j = np.divmod(np.flatnonzero(often & (x[at : at + rows] @ y.T >= cosine)), len(y))
        else:
            keep = np.einsum("nd,nd->n", x[at + i], y[j]) >= cosine
            i, j = i[keep], j[keep]
        cuts = np.searchsorted(i, np.arange(len(part) + 1))
        for r in range(len(part)):
            if cuts[r] < cuts[r + 1]:
                yield at + r, j[cuts[r] : cuts[r + 1]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS, recall: float = RECALL, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine `cosine` or more: vec_id, n_links, component_id, kept; a row for each row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. Equal vectors count once with their number, so a vector that
    many rows have costs no more; rows that repeat an id count as vectors of their own. A null id is
    kept. Other columns are not looked at. Blocks of the sorted first projection are compared where
    they come within a window of each other. Blocks are written once, a row each, and tasks read them
    by pairs of partitions, so no vector is copied for the blocks that it is compared with; a task
    gives a row for each of its vectors and partial groups. The driver holds the bounds between
    blocks, one number for `block` vectors.
    """
    spark = vectors.sparkSession
    far = math.sqrt(2 - 2 * cosine)
    wide = quantile(WINDOW_SHARE) * far
    # a step less: both ends are rounded
    least = least_count(projections, math.erf((wide * (STEPS - 0.5) / STEPS) / far / math.sqrt(2)), recall)
    reach = quantile(recall) * far

    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, place = usable(b.column(1), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(place)], names=["vec_id", "raw", "place"])

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(read, "vec_id long, raw binary, place double")
    own = own.withColumn("key", F.xxhash64("raw", F.length("raw")))
    held = common.cut(own.where("raw is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("place").alias("place")))
    total, size = held.agg(F.count("*"), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    k = max(1, math.ceil(total / block))
    bounds = np.unique(held.agg(F.percentile_approx("place", [i / k for i in range(1, k)], 100 * k)).first()[0]) if k > 1 else np.zeros(0)
    shared = spark.sparkContext.broadcast(bounds)
    each = max(1, min(math.isqrt(k), int(PARTITION * k / max(size, 1))))

    @common.tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        _, last = neighbours(bounds, reach)
        for b in batches:
            mine = np.searchsorted(bounds, b.column(3).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(last[mine]), pc.binary_length(b.column(2)).cast(pa.int64()), *b.columns[:3]], names=["block", "last", "size", "key", "n", "raw"])

    def packed(rows: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        """One row of all these vectors, which have the same block and size."""
        t = pa.Table.from_batches(rows)
        key, n = (t.column(c).to_numpy().tobytes() for c in ("key", "n"))
        head = [pa.array([t.column(c)[0].as_py()], pa.int64()) for c in ("block", "last", "size")]
        return pa.RecordBatch.from_arrays([*head, pa.array([part]), *(pa.array([x], pa.binary()) for x in (key, n, b"".join(t.column("raw").to_pylist())))], names=["block", "last", "size", "part", "key", "n", "raw"])

    @common.tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, count, part = None, [], 0, 0
        for b in batches:
            block_of, size_of = (b.column(i).to_numpy() for i in (0, 2))
            cuts = np.flatnonzero((np.diff(block_of) != 0) | (np.diff(size_of) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True) if b.num_rows else ():
                if now != (here := (block_of[lo], size_of[lo])):
                    if rows:
                        yield packed(rows, part)
                    now, rows, count, part = here, [], 0, 0
                while lo < hi:
                    # a block grows beyond its bounds only by ties
                    take = min(hi - lo, 2 * block - count)
                    rows.append(b.slice(lo, take))
                    lo, count = lo + take, count + take
                    if count == 2 * block:
                        yield packed(rows, part)
                        rows, count, part = [], 0, part + 1
        if rows:
            yield packed(rows, part)

    def met_in(key_x: np.ndarray, n_x: np.ndarray, x: np.ndarray, key_y: np.ndarray, n_y: np.ndarray, y: np.ndarray, same: bool) -> pa.Table:
        """Links of the vectors of two packed rows, or of one with itself."""
        key, n = (key_x, n_x) if same else (np.concatenate([key_x, key_y]), np.concatenate([n_x, n_y]))
        links, root, shift = np.zeros(len(key), np.int64), np.arange(len(key)), 0 if same else len(key_x)
        for r, found in count_links(x, y, cosine, projections, wide, least):
            mates = found + shift
            if same:
                mates = mates[mates != r]
            else:
                links[mates] += n[r]
            links[r] += n[mates].sum()
            roots = root[np.append(mates, r)]
            if (roots != roots[0]).any():
                root[np.isin(root, roots)] = roots.min()
        some = np.flatnonzero(links)
        return pa.table([pa.array(key[some]), pa.array(key[root[some]]), pa.array(links[some])], names=["key", "root", "links"])

    @common.tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        sum_up = lambda: pa.concat_tables(tables).group_by(["key", "root"], use_threads=False).aggregate([("links", "sum")]).select(["key", "root", "links_sum"]).rename_columns(["key", "root", "links"])
        for b in batches:
            for r in range(b.num_rows):
                same = b.column(0)[r].as_py()
                key_x, n_x, raw_x, key_y, n_y, raw_y = (c[r].as_buffer() for c in b.columns[1:])
                key_x, n_x, key_y, n_y = (np.frombuffer(c, np.int64) for c in (key_x, n_x, key_y, n_y))
                x = as_matrix(raw_x, len(key_x), kind)
                y = x if same else as_matrix(raw_y, len(key_y), kind)
                tables.append(met_in(key_x, n_x, x, key_y, n_y, y, same))
                if sum(t.num_rows for t in tables) > HELD:
                    tables = [sum_up()]
                    if tables[0].num_rows > HELD // 2:
                        yield from tables.pop().to_batches()
        if tables:
            yield from sum_up().to_batches()

    dealt = held.select("key", "n", "raw", "place").mapInArrow(number, "block long, last long, size long, key long, n long, raw binary")
    # sorting within the partitions of a repartition by block: equal blocks stand together
    parts = math.ceil(k / each)
    blocks = common.cut(dealt.repartition(parts, "block").sortWithinPartitions("block", "size").mapInArrow(pack, "block long, last long, size long, part long, key binary, n binary, raw binary").coalesce(parts))
    kinds = common.cut(held.select("key", "n"))
    common.drop(held)
    x, y = (blocks.select(*(F.col(c).alias(c + side) for c in blocks.columns)) for side in ("_x", "_y"))
    same = (F.col("block_x") == F.col("block_y")) & (F.col("part_x") == F.col("part_y"))
    # no equality at the top: an equi-join would copy the blocks to each other
    later = (F.col("block_x") < F.col("block_y")) | (F.col("block_x") <= F.col("block_y")) & (F.col("part_x") <= F.col("part_y"))
    pairs = x.hint("shuffle_replicate_nl").join(y, (F.col("size_x") <= F.col("size_y")) & (F.col("size_x") >= F.col("size_y")) & later & (F.col("block_y") <= F.col("last_x")))
    met = common.cut(pairs.select(same.alias("same"), *(c + side for side in ("_x", "_y") for c in ("key", "n", "raw"))).mapInArrow(compare, "key long, root long, links long"))
    common.drop(blocks)
    groups = common.components(spark, met.select(F.col("key").alias("a"), F.col("root").alias("b")))
    facts = kinds.select("key", "n").join(met.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(groups.select(F.col("id").alias("key"), "root"), "key", "left")
    facts = facts.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("group"))
    rows = common.cut(own.select("vec_id", F.when(F.col("raw").isNotNull(), F.col("key")).alias("key"))).join(facts, "key", "left")
    first = rows.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("least"))
    out = rows.join(first, "group", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, count(*) AS n FROM l GROUP BY x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.y, vec_id)) AS component_id, coalesce(m.y, vec_id) >= vec_id AS kept
FROM v LEFT JOIN c ON c.x = vec_id LEFT JOIN m ON m.x = vec_id
"""
