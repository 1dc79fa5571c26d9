"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common

#: At most so many labelled rows are learned from (those with the smallest hash of their id).
MOST_LABELS = 20_000
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
FEATURES = [
    "log_chars", "log_words", "mean_word", "std_word", "long_words", "short_words", "one_char_words", "upper", "digit", "symbol", "punctuation", "comma", "full_stop", "exclamation",
    "pipe", "other_bytes", "space", "entropy", "distinct_words", "distinct_pairs", "log_lines", "mean_line", "distinct_lines", "short_lines", "ends_marked", "top_word",
]


def statistics(text: str) -> list[float]:
    """The FEATURES of a whole text; an empty one has zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    if not words:
        return [np.log1p(len(text))] + [0.0] * (len(FEATURES) - 1)
    hist = np.bincount(data, minlength=256)
    n, nw = len(data), len(words)
    size = np.fromiter(map(len, words), np.int32, nw)
    share = hist[hist > 0] / n
    lines = [x for x in text.split("\n") if x]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(len(text)), np.log1p(nw), float(size.mean()), float(size.std()), float((size > 12).mean()), float((size <= 3).mean()), float((size == 1).mean()),
        hist[65:91].sum() / n, hist[48:58].sum() / n, hist[SYMBOLS].sum() / n, hist[PUNCTUATION].sum() / n, hist[44] / n, hist[46] / n, hist[33] / n,
        hist[124] / n, hist[128:].sum() / n, hist[32] / n, float(-(share * np.log2(share)).sum()), len(counts) / nw, len(set(zip(words, words[1:], strict=False))) / max(nw - 1, 1),
        np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), sum(x[-1] in ".!?\"" for x in lines) / len(lines), max(counts.values()) / nw,
    ]


@dataclass
class Trees:
    """Boosted complete trees, flattened: inner nodes and leaves in level order, a row a tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0, least: float = 2.0) -> Trees:
    """Histogram boosting of the logistic loss; deterministic. Without rows, or with one class only, the prior."""
    p = (y.sum() + 1) / (len(y) + 2)
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    total = np.full(len(y), out.start)
    trees = []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-total))
        g, h = y - q, q * (1 - q)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            where = np.full((width, 2), -1)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = at * bins + binned[:, j]
                gs, hs = (np.bincount(key, weights=v, minlength=width * bins).reshape(width, bins).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(edges[j])]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                where[better] = np.stack([np.full(width, j), top], 1)[better]
            for k, (j, b) in enumerate(where):
                if j >= 0:
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        own = node - inner
        leaf = rate * np.bincount(own, weights=g, minlength=leaves) / (np.bincount(own, weights=h, minlength=leaves) + smooth)
        total += leaf[own]
        trees.append((feature, threshold, leaf))
    return Trees(*(np.stack(v) for v in zip(*trees, strict=True)), out.start)


def remainder(id_col) -> F.Column:
    """crc32 of the id as text, modulo 3; a null id has none."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        x = np.array([statistics(t or "") for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Learn from at most `most` labelled documents that are not held out. Null ids and labels are left out; of several labels or texts of an id one counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(remainder(F.col("id")) != 1).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    y = {r.id: int(r.y > 0) for r in known.collect()}
    chosen = docs.sparkSession.createDataFrame([(k,) for k in y] or [(None,)], "id long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left_semi")
    rows = sorted((r.doc_id, r.x) for r in own.mapInArrow(_features, "doc_id long, x array<double>").dropDuplicates(["doc_id"]).collect())
    return fit(np.array([x for _, x in rows]).reshape(-1, len(FEATURES)), np.array([y[i] for i, _ in rows], float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted. Null texts count as empty and get a score as well; each row of the input gives one row; a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text"):
            s = shared.value.score(np.array([statistics(t or "") for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
