"""N-gram Jaccard join: shared prefix shingles make clusters, signature trees in them make links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common

WORDS = 5
#: Similarity in percent; compared in whole numbers.
PERCENT = 75
#: Bits of a set's bitmap, eight for each token of the median set within these limits; sets below a node of the lowest level.
BITS, MOST_BITS = 2048, 1 << 16
LEAF = 64
#: Bytes of shingle sets that one task compares at most; larger clusters are compared in blocks of half of it.
BLOCK_BYTES = 24 << 20
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _A)]), dtype=np.uint64)[:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of concatenated texts, and how many words begin before each text's end."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1] | edge[1:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    # place in its word of each byte, white space skipped
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(inside, _BYTE[data] * powers(int(place.max()) + 1)[place], np.uint64(0))
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, ends = word_hashes(data, off)
    rolled = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _A + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        if z - a >= words:
            out.append(np.unique(rolled[a : z - words + 1]))
        elif z > a:
            total = np.uint64(z - a)
            for x in h[a:z]:
                total = mix(np.array([total * _A + x], np.uint64))[0]
            out.append(np.array([total], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s ^ _B)) + np.uint64(len(s))], np.uint64))[0].astype(np.int64)) if len(s) else 0


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap at which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def _sets_of(b: pa.RecordBatch, words: int) -> list[np.ndarray]:
    data, off = common.text_bytes(b.column(1))
    with np.errstate(over="ignore"):
        return shingle_sets(np.frombuffer(data.tobytes().translate(_UPPER), np.uint8), off, words)


class SignatureTree:
    """Sets in a hierarchy of nodes with OR-combined token bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        n = len(sets)
        size = np.array([len(s) for s in sets])
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        # sizes that may link stand near each other, and of those sets with the same least token
        grade = np.floor(np.log(np.maximum(size, 1)) / np.log(4 / 3))
        self.order = np.lexsort((size, least, grade))
        self.sets = [sets[i] for i in self.order]
        # bitmaps that long sets do not fill
        width = int(min(MOST_BITS, max(BITS, 2 ** int(np.ceil(np.log2(max(8 * np.median(size), 1)))))))
        bits = np.zeros((n, width // 64), np.uint64)
        for row, s in enumerate(self.sets):
            at = (mix(s) % np.uint64(width)).astype(np.int64)
            np.bitwise_or.at(bits[row], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        size = size[self.order]
        slack = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, slack)]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > 1:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))

    def may_link(self, level: int, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Of nodes of the same level those whose sets can link with a set below node i, by size and by possible overlap."""
        b, lo, hi, sl = self.levels[level]
        # common tokens are at most the common bits, and those that share a bit within one set
        overlap = np.bitwise_count(b[i] & b[others]).sum(1).astype(np.int64) + np.minimum(sl[i], sl[others])
        overlap = np.minimum(overlap, np.minimum(hi[i], hi[others]))
        fits = (100 * hi[others] >= percent * lo[i]) & (100 * hi[i] >= percent * lo[others])
        return others[fits & ((100 + percent) * overlap >= percent * (lo[i] + lo[others]))]

    def links(self, percent: int, known: np.ndarray) -> np.ndarray:
        """The root of each set: one member of its component of links, by dual traversal.

        Sets with an equal number in `known` are one component from the start. Pairs of nodes wait on the stack, a node with itself first; sets are compared where both are
        below nodes of the lowest level. What one component holds already is not compared again.
        """
        n = len(self.sets)
        _, first, label = np.unique(known[self.order], return_index=True, return_inverse=True)
        root = first[label]
        members: dict[int, list[int]] = {}
        for x, r in enumerate(root.tolist()):
            members.setdefault(r, []).append(x)

        def join(a: int, b: int) -> None:
            a, b = int(root[a]), int(root[b])
            if a != b:
                a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
                root[members[b]] = a
                members[a] += members.pop(b)

        stack = [(len(self.levels) - 1, 0, 0)] if n else []
        while stack:
            level, i, j = stack.pop()
            span = LEAF**level
            left, right = root[i * span : (i + 1) * span], root[j * span : (j + 1) * span]
            if (left == left[0]).all() and (right == left[0]).all():
                continue
            below = np.arange(j * LEAF, min(len(self.levels[level - 1][0]), (j + 1) * LEAF))
            for x in range(i * LEAF, min(len(self.levels[level - 1][0]), (i + 1) * LEAF)):
                others = below[below > x] if i == j else below
                if level > 1:
                    stack += [(level - 1, x, int(y)) for y in self.may_link(level - 1, x, others, percent)]
                elif len(others := others[root[others] != root[x]]) and len(others := self.may_link(0, x, others, percent)):
                    for y in others[self._linked(x, others, percent)]:
                        join(x, int(y))
            if level > 1 and i == j:
                stack += [(level - 1, int(x), int(x)) for x in below]
        out = np.empty(n, np.int64)
        out[self.order] = self.order[root]
        return out

    def _linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        own, sizes = self.sets[x], np.array([len(self.sets[y]) for y in others])
        flat = np.concatenate([self.sets[y] for y in others])
        met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes) - sizes)
        return 100 * both >= percent * (sizes + len(own) - both)


def _documents(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_shingles and set_hash of every document."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text", 2 << 20):
            sets, sizes = _sets_of(b, words), np.diff(common.text_bytes(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())], names=["doc_id", "text_hash", "n_bytes", "n_shingles", "set_hash"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_bytes long, n_shingles long, set_hash long")


def _shared_counts(own: DataFrame, words: int, shares: int) -> DataFrame:
    """(set_hash, shared, classes): how many shingles of a set some other set has as well, and how frequent each is.

    Shingles go to their share as 32 bits of their hash, so a count can be too high by a collision,
    never too low. classes holds, for each share, a byte for each of the set's shingles there in
    the order of their hashes: the logarithm of the number of sets that have it.
    """

    @common.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text", 4 << 20):
            sets = {set_hash(s): s for s in _sets_of(b, words) if len(s)}
            if not sets:
                continue
            ids = np.array(list(sets), np.int64)
            token = np.concatenate(list(sets.values()))
            who = np.repeat(np.arange(len(ids)), [len(s) for s in sets.values()])
            share = (token % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            mark, who, share = (token[order] >> np.uint64(32)).astype(np.uint32), who[order], share[order]
            found, first = np.unique(share, return_index=True)
            cuts = np.append(first, len(share))
            blobs = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                rows, n = np.unique(who[a:z], return_counts=True)
                blobs.append(np.array([len(rows), z - a], np.int64).tobytes() + ids[rows].tobytes() + n.astype(np.uint32).tobytes() + mark[a:z].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], names=["share", "blob"])

    def count(group: pa.Table) -> pa.Table:
        share = group.column("share")[0].as_py()
        sets: dict[int, np.ndarray] = {}
        for chunk in group.column("blob").chunks:
            for x in chunk:
                raw = x.as_buffer()
                n, m = np.frombuffer(raw, np.int64, 2)
                size = np.frombuffer(raw, np.uint32, n, 16 + 8 * n)
                marks = np.frombuffer(raw, np.uint32, m, 16 + 12 * n)
                sets.update(zip(np.frombuffer(raw, np.int64, n, 16).tolist(), np.split(marks, np.cumsum(size)[:-1]), strict=True))
        mark = np.concatenate(list(sets.values()))
        size = np.array([len(x) for x in sets.values()])
        order = np.argsort(mark, kind="stable")
        new = np.flatnonzero(np.append(True, mark[order][1:] != mark[order][:-1]))
        times = np.diff(np.append(new, len(mark)))
        n = np.empty(len(mark), np.int64)
        n[order] = np.repeat(times, times)
        grades = np.minimum(np.rint(4 * np.log2(n)), 255).astype(np.uint8).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])
        shared = np.add.reduceat((n > 1).astype(np.int64), at[:-1])
        return pa.table([pa.array(list(sets), pa.int64()), pa.array(np.full(len(size), share), pa.int32()), pa.array(shared), pa.array([grades[a:z] for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["set_hash", "share", "shared", "grades"])

    met = own.mapInArrow(emit, "share long, blob binary").groupBy("share").applyInArrow(count, "set_hash long, share int, shared long, grades binary")
    return met.groupBy("set_hash").agg(F.sum("shared").alias("shared"), F.collect_list(F.struct("share", "grades")).alias("classes"))


def by_frequency(s: np.ndarray, classes: list, shares: int) -> np.ndarray:
    """The shingles of a set, the rarest first; of equally rare ones by hash. The same order holds for all sets."""
    share = (s % np.uint64(shares)).astype(np.int64)
    grade = np.zeros(len(s), np.uint8)
    for c in classes:
        grade[share == c["share"]] = np.frombuffer(c["grades"], np.uint8)
    return s[np.lexsort((s, grade))]


def _prefix_edges(texts: DataFrame, words: int, percent: int, frequency_shares: int, shares: int) -> DataFrame:
    """Edges (a, b) between sets that share a shingle of their prefixes, from the least set of each shingle.

    Sets that link share a shingle among the first n - ceil(n * percent / 100) + 1 of both, in any
    order of shingles that holds for all; here the rarest come first. Only sets whose sizes may
    link, or that sets of sizes between them connect, get an edge.
    """

    @common.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text", 8 << 20):
            tokens, who, size = [], [], []
            seen: set[int] = set()
            for s, want, classes in zip(_sets_of(b, words), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if set_hash(s) != want or want in seen:
                    continue
                seen.add(want)
                n = len(s) - -(-percent * len(s) // 100) + 1
                tokens.append(by_frequency(s, classes, frequency_shares)[:n])
                who.append(np.full(n, len(size)))
                size.append((want, len(s)))
            if not tokens:
                continue
            token, who, ids = np.concatenate(tokens), np.concatenate(who), np.array(size, np.int64)
            share = (token % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            token, who, share = token[order], who[order], share[order]
            found, first = np.unique(share, return_index=True)
            cuts = np.append(first, len(share))
            blobs = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                rows, which = np.unique(who[a:z], return_inverse=True)
                blobs.append(np.array([len(rows), z - a], np.int64).tobytes() + ids[rows].tobytes() + token[a:z].tobytes() + which.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], names=["share", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        tokens, sets = [], []
        for chunk in group.column("blob").chunks:
            for x in chunk:
                raw = x.as_buffer()
                n, m = np.frombuffer(raw, np.int64, 2)
                ids = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(-1, 2)
                tokens.append(np.frombuffer(raw, np.uint64, m, 16 + 16 * n))
                sets.append(ids[np.frombuffer(raw, np.uint32, m, 16 + 16 * n + 8 * m)])
        token, set_ = np.concatenate(tokens), np.concatenate(sets)
        order = np.lexsort((set_[:, 1], token))
        token, (set_, size) = token[order], set_[order].T
        # runs of a shingle in which each size may link with the next
        new = np.append(True, (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:]))
        first = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(set_, first), np.diff(np.append(first, len(token))))
        pairs = np.unique(np.stack([least, set_], 1)[least != set_], axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return texts.select("doc_id", "text", "want", "classes").mapInArrow(emit, "share long, blob binary").groupBy("share").applyInArrow(meet, "a long, b long")


def _compared(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between sets that meet in a task: rows of texts, by cluster and each of their `tasks`.

    Sets of one `known` component are linked already.
    """

    names = ["cluster", "task", "id", "known", "tokens"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    @common.tidy
    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text", 2 << 20):
            own_sets = _sets_of(b, words)
            hashes = np.array([set_hash(s) for s in own_sets], np.int64)
            rows, size = [], 0
            for i in np.flatnonzero(hashes == b.column(2).to_numpy()).tolist():
                cluster, known, blob = b.column(3)[i].as_py(), b.column(4)[i].as_py(), own_sets[i].tobytes()
                for task in b.column(5)[i].as_py():
                    rows.append((cluster, task, int(hashes[i]), known, blob))
                    size += len(blob)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)

    @common.tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tasks come whole and in order; each is compared when its last row has come."""
        held: dict[int, tuple[int, np.ndarray]] = {}
        at = None

        def done() -> pa.RecordBatch:
            ids, known = list(held), np.array([k for k, _ in held.values()], np.int64)
            roots = SignatureTree([s for _, s in held.values()]).links(percent, known) if (known != known[0]).any() else np.arange(len(ids))
            pairs = [(ids[r], ids[k]) for k, r in enumerate(roots) if r != k]
            return pa.RecordBatch.from_arrays([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], names=["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(2)), strict=True))
            for k, (key, i, known) in enumerate(zip(keys, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if key != at:
                    if len(held) > 1:
                        yield done()
                    held, at = {}, key
                held[i] = known, np.frombuffer(b.column(4)[k].as_buffer(), np.uint64).copy()
        if len(held) > 1:
            yield done()

    dealt = texts.select("doc_id", "text", "want", "cluster", "known", "tasks").mapInArrow(located, "cluster long, task long, id long, known long, tokens binary")
    return dealt.repartition("cluster", "task").sortWithinPartitions("cluster", "task", "id").mapInArrow(compare, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of `percent` or more.

    Returns doc_id, text_hash, n_shingles, component_id and first: a row for each row of docs. first
    tells whether the row has the component's smallest id (a null one last) and, of that, the text
    of least hash; repeated rows are all first or none of them. Null, empty and wordless texts have no shingles and
    are a component each; texts of fewer than `words` words have one. A null id is no one's
    component id unless nothing else is there; repeated rows and equal sets are one component; other
    columns are not looked at.

    Equal sets count once. A set of which fewer shingles than `percent` of them stand in other sets
    links with none. Of the others, those that share a prefix shingle form clusters (connected
    components of the sharing), so a set goes to one task only; there, signature trees find the
    links. A cluster too large for a task is dealt into blocks, and compared twice: first each block
    with the next one, which makes most of a group of near copies one component; then the sets
    outside the cluster's largest component with those and with each other, a task for each pair of
    blocks. Within the largest component nothing is compared again, so its size adds no pairs of its own.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    facts = common.cut(_documents(own, words))
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    shares = common.buckets(total, 32 << 20, least=16)
    shared = _shared_counts(own, words, shares)
    # the row that stands for all of its set
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    kinds = common.cut(facts.where("n_shingles > 0").groupBy("set_hash").agg(F.first("n_shingles").alias("n"), best))
    alive = kinds.join(shared, "set_hash").where(100 * F.col("shared") >= percent * F.col("n")).select("best.doc_id", "best.text_hash", F.col("set_hash").alias("want"), "n", "classes")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash")
    texts = own.where("text is not null").select(key.alias("row"), "doc_id", "text").join(alive.select(key.alias("row"), "want", "n", "classes"), "row")
    texts = common.cut(texts.dropDuplicates(["row"]).select("doc_id", "text", "want", "n", "classes"))
    edges = _prefix_edges(texts, words, percent, shares, common.buckets(total, 48 << 20))
    clusters = common.components(spark, edges)
    sized = common.cut(texts.select(F.col("want").alias("id"), "n").dropDuplicates(["id"]).join(clusters, "id").select("id", F.col("root").alias("cluster"), "n"))
    # few clusters are so large: no more than the sets' bytes / BLOCK_BYTES
    large = common.cut(sized.groupBy("cluster").agg((F.sum("n") * 8).alias("bytes")).where(F.col("bytes") > BLOCK_BYTES))
    blocks = lambda size: F.ceil(size / (BLOCK_BYTES / 2))
    block = F.pmod("id", blocks(F.col("bytes")))
    ring = F.when(F.col("bytes").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(block, F.pmod(block - 1, blocks(F.col("bytes")))))
    tasks = common.lookup(sized, large, "cluster").select(F.col("id").alias("want"), "cluster", F.col("id").alias("known"), ring.alias("tasks"))
    groups = common.components(spark, _compared(texts.join(tasks, "want"), words, percent))
    if not large.isEmpty():
        found = common.lookup(sized.join(F.broadcast(large.select("cluster")), "cluster", "left_semi"), groups, "id").withColumn("root", F.coalesce("root", "id"))
        found = common.cut(found)
        mass = found.groupBy("cluster", "root").agg((F.sum("n") * 8).alias("bytes"))
        most = F.max(F.struct("bytes", "root"))
        sides = mass.groupBy("cluster").agg(most.alias("most"), blocks(F.sum("bytes") - most["bytes"]).alias("rest")).where("rest > 0")
        sides = common.cut(sides.select("cluster", F.col("most.root").alias("main"), "rest", (F.col("rest") + blocks(F.col("most.bytes"))).alias("all")))
        placed = common.lookup(found, sides, "cluster").where("rest > 0")
        main = F.col("root") == F.col("main")
        own_block = F.when(main, F.col("rest") + F.pmod("id", F.col("all") - F.col("rest"))).otherwise(F.pmod("id", "rest"))
        others = F.sequence(F.lit(0).cast("long"), F.when(main, F.col("rest")).otherwise(F.col("all")) - 1)
        pairs = F.transform(others, lambda o: F.least(o, own_block) * F.col("all") + F.greatest(o, own_block))
        tasks = placed.select(F.col("id").alias("want"), "cluster", F.col("root").alias("known"), pairs.alias("tasks"))
        more = _compared(texts.join(tasks, "want"), words, percent)
        groups = common.components(spark, groups.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    # sets that link with others are named after their group; then documents after their sets
    grouped = common.cut(kinds.join(groups.select(F.col("id").alias("set_hash"), "root"), "set_hash").select("set_hash", "root", "best"))
    least = grouped.groupBy("root").agg(F.min("best").alias("best"))
    named = common.lookup(grouped.select("set_hash", "root"), least, "root").select("set_hash", "best")
    rest = kinds.select("set_hash", "best").join(grouped.select("set_hash"), "set_hash", "left_anti")
    out = common.lookup(facts, named.unionByName(rest), "set_hash")
    same = F.col("best").isNull() | F.col("best").eqNullSafe(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("best.doc_id", "doc_id").alias("component_id"), same.alias("first"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).drop("text_hash", "first")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
