"""Suffix-array dedup: passages of 100 bytes that also start earlier go, however the copies lie.

Suffixes are dealt into buckets by the anchor of their first `length` bytes: the k-mer of least
hash in them, the leftmost of equals, so that equal passages meet in one bucket at the same place
before their anchor. A segment is a run of starts with one anchor, and the bytes that they cover.
Equal segments count once. Then each task sorts its buckets' suffixes, a block of buckets at a time:
by their first `PERIOD` bytes, and, where these tie, by the rank of a sample suffix from a
difference cover modulo `PERIOD`, ranked beforehand, and by the last bytes. Segments are laid out
with their anchors at multiples of PERIOD, so all suffixes that may tie have the same shift to the
cover, and ranks are kept for cover positions only: about a fifth of a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm import common
from canopy.llm.jaccard import mix

LENGTH = 100
ANCHOR = 32
#: A perfect difference cover: each difference modulo 31 is that of two of its numbers.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text in whose segments a task looks at a time; its arrays take some hundred times that.
PIECE = 1 << 20
#: Bytes of segments sorted at a time.
BLOCK = 2 << 20
#: Anchors with so many different segments are dealt anew, each start by the hash of its passage.
HOT = 2000
_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SAME, TEXT, SPREAD = 1, 2, 3


def octets(data: np.ndarray) -> np.ndarray:
    """The number that the 8 bytes from each place on make, the first byte the highest; zeros beyond the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    x = (x[:-4] << np.uint64(32)) | x[4:]
    return x[: len(data)]


class Anchors:
    """The segments of texts that lie one after the other in `data`."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> None:
        self.data, self.off = data, off
        n = len(data)
        if n < length or not (np.diff(off) >= length).any():
            self.doc = self.lo = self.hi = self.at = np.zeros(0, np.int64)
            self.key = self.segment = np.zeros(0, np.uint64)
            return
        self.eight = octets(data)
        with np.errstate(over="ignore"):
            m = n - k + 1
            h = mix(self.eight[:m])
            for j in range(8, k, 8):
                h = mix(h * _M + self.eight[j : j + m])
        bits = np.uint64(max(int(n).bit_length(), 1))
        low = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
        span, width = length - k + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low
        place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the anchor, for each start
        size = np.maximum(np.diff(off) - length + 1, 0)
        starts = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        doc = np.repeat(np.arange(len(size)), size)
        place = place[starts]
        new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
        first = np.flatnonzero(new)
        self.doc, self.lo, self.at = doc[first], starts[first], place[first]
        self.hi = starts[np.append(first[1:], len(starts)) - 1]
        self.key = h[self.at]
        self.segment = self.hashes(self.lo, self.hi + length, self.at - self.lo)

    def hashes(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Hashes of data[begin:end], each with its salt."""
        with np.errstate(over="ignore"):
            if not hasattr(self, "sums"):
                power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.data) - 1, _M)]), dtype=np.uint64)
                # the bytes beyond a passage must not count: only whole numbers of 8 bytes, and the last ones again
                self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.eight) * power, dtype=np.uint64)])
                self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.data) - 1, _INV)]), dtype=np.uint64)
            total = (self.sums[end - 7] - self.sums[begin]) * self.back[begin]
            return mix(total ^ mix((end - begin).astype(np.uint64) * _M + salt.astype(np.uint64)))


def class_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the first counts most), and where in it a row differs from the one before."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def repeated(bucket: np.ndarray, texts: list[bytes], anchor: np.ndarray, n_starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the starts of segments in the order of their first appearance: whether an equal passage starts in an earlier segment of the bucket.

    Segment i has n_starts[i] starts from its begin on, and its anchor `anchor[i]` bytes after that.
    """
    pad = length + 2 * PERIOD
    size = np.array([len(t) for t in texts])
    # anchors at multiples of PERIOD
    room = -(-(size + pad) // PERIOD) * PERIOD + 2 * PERIOD
    base = np.concatenate([[0], np.cumsum(room)[:-1]])
    begin = base + (-anchor) % PERIOD
    data = np.full(int(room.sum()) + 2 * length, 0xFF, np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(flat))
    data[where] = flat
    eight = octets(data)

    def words(p: np.ndarray, n: int = PERIOD) -> list[np.ndarray]:
        """n bytes from p on as numbers; they overlap where n is no multiple of 8."""
        return [eight[p + j] for j in range(0, n - 7, 8)] + ([eight[p + n - 8]] if n % 8 else [])

    # ranks of the cover sample by their next 2 * PERIOD bytes
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    sample = np.flatnonzero(np.tile(in_cover, len(data) // PERIOD))
    sample = sample[sample < len(data) - 2 * length]
    order, new = class_of(words(sample, 2 * PERIOD))
    rank = np.empty(len(sample), np.int64)
    rank[order] = np.cumsum(new)
    # from a start, the first sample position between PERIOD - 24 and PERIOD bytes on
    shift = np.array([next(d for d in range(7, PERIOD + 1) if in_cover[(r + d) % PERIOD]) for r in range(PERIOD)])
    row = np.repeat(np.arange(len(texts)), n_starts)
    rel = np.arange(n_starts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n_starts)[:-1]]), n_starts)
    start = begin[row] + rel
    before = anchor[row] - rel
    # one bucket after the other, by the first PERIOD bytes; only ties look further
    head = [bucket[row], before, *words(start)]
    order, new = class_of(head)
    group = np.cumsum(new)
    tied = np.bincount(group)[group] > 1
    order = order[tied]
    out = np.zeros(len(start), bool)
    if len(order):
        first = np.empty(len(start), np.int64)
        first[np.concatenate([order])] = group[tied]
        s = start[order]
        far = np.searchsorted(sample, s + shift[s % PERIOD])
        keys = [first[order], rank[far], *words(s + length - PERIOD)]
        o, new = class_of([*keys, row[order]])
        sorted_ = order[o]
        same = np.zeros(len(o), bool)
        same[1:] = True
        for k in keys:
            x = k[o]
            same[1:] &= x[1:] == x[:-1]
        out[sorted_] = same
    return out


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unblob(raw, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _meet(group: pa.Table) -> pa.Table:
    """A share of anchors: which segments are not the first of their kind (SAME), and which have to be sorted (TEXT) or dealt anew (SPREAD)."""
    parts: list[list[np.ndarray]] = []
    for chunk in group.column("blob").chunks:
        for x in chunk:
            ids, versions, which, key, segment, number = _unblob(x.as_buffer(), np.int64, np.int64, np.uint32, np.uint64, np.uint64, np.uint32)
            parts.append([ids[which], versions[which], key, segment, number])
    doc, version, key, segment, number = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((number, version, doc, segment, key))
    doc, version, key, segment, number = (c[order] for c in (doc, version, key, segment, number))
    new_key = np.append(True, key[1:] != key[:-1])
    new_segment = new_key | np.append(True, segment[1:] != segment[:-1])
    kinds = np.add.reduceat(new_segment.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    # repeated rows, of the same id and text, are one document
    again = ~new_segment & np.append(False, (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]) & (number[1:] == number[:-1]))
    first = np.maximum.accumulate(np.where(new_segment, np.arange(len(doc)), 0))
    of_first = again & (doc == doc[first]) & (version == version[first]) & (number == number[first])
    flag = np.where(~new_segment & ~of_first, SAME, np.where(kinds > HOT, SPREAD, np.where(kinds > 1, TEXT, 0))).astype(np.uint8)
    tell = np.flatnonzero((flag > 0) & ~again)
    order = tell[np.lexsort((number[tell], version[tell], doc[tell]))]
    doc, version, number, flag = doc[order], version[order], number[order], flag[order]
    cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])) if len(doc) else np.zeros(0, bool))
    ends = np.append(cuts[1:], len(doc))[: len(cuts)]
    blobs = [_blob(number[a:z], flag[a:z]) for a, z in zip(cuts, ends, strict=True)]
    return pa.table([pa.array(doc[cuts]), pa.array(version[cuts]), pa.array(blobs, pa.binary())], names=["doc_id", "version", "flags"])


def _flags(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    got = [_unblob(x, np.uint32, np.uint8) for x in blobs or ()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate([g[0] for g in got]).astype(np.int64), np.concatenate([g[1] for g in got])


def _own_segments(b: pa.RecordBatch, length: int, k: int) -> tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a batch of documents, the number of each in its document, and where documents' segments begin."""
    data, off = common.text_bytes(b.column(2))
    seg = Anchors(data, off, length, k)
    begins = np.searchsorted(seg.doc, np.arange(b.num_rows + 1))
    return seg, np.arange(len(seg.doc)) - begins[seg.doc] if len(seg.doc) else seg.doc, begins, off


def removed_ranges(docs: DataFrame, length: int, k: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents with the blobs that say which of their passages start earlier elsewhere: doc_id, version, text, flags, starts, and the columns to carry as one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    extra = [F.struct(*[docs[f"`{c}`"] for c in carry]).alias("extra")] if carry else []
    # no id sorts before all ids
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"), *extra)
    extra = ["extra"] * bool(carry)
    shares = common.buckets(common.text_total(docs, text_col), 8 << 20)

    @common.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text", PIECE):
            seg, number, _, _ = _own_segments(b, length, k)
            if not len(seg.doc):
                continue
            ids, versions = b.column(0).to_numpy(), b.column(1).to_numpy()
            share = (seg.key % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            found, first = np.unique(share[order], return_index=True)
            blobs = []
            for own_rows in np.split(order, first[1:]):
                rows, which = np.unique(seg.doc[own_rows], return_inverse=True)
                blobs.append(_blob(ids[rows], versions[rows], which.astype(np.uint32), seg.key[own_rows], seg.segment[own_rows], number[own_rows].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], names=["share", "blob"])

    told = keyed.select("doc_id", "version", "text").mapInArrow(emit, "share long, blob binary").groupBy("share").applyInArrow(_meet, "doc_id long, version long, flags binary")
    flags = told.groupBy("doc_id", "version").agg(F.collect_list("flags").alias("flags"))
    # what is carried goes through both uses of this join, so that its shuffle serves both
    marked = keyed.join(flags, ["doc_id", "version"], "left").select("doc_id", "version", "text", "flags", *extra)

    @common.tidy
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments to be sorted, by anchor; and starts of hot anchors, by passage.

        Of a passage that a batch has more than once only the first start goes to its bucket. The
        others are known to be repeated and go by document, as runs with anchor -1 and no bytes.
        """
        for b in common.pieces(batches, "text", PIECE):
            seg, number, begins, off = _own_segments(b, length, k)
            ids, versions, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), seg.data.tobytes()
            out: list[list] = [[] for _ in range(7)]
            seen, hot = set(), []
            for i, blobs in enumerate(b.column(3).to_pylist()):
                if not blobs or (ids[i], versions[i]) in seen:
                    continue
                seen.add((ids[i], versions[i]))
                at, flag = _flags(blobs)
                for j, f in zip(at + begins[i], flag, strict=True):
                    lo, hi = int(seg.lo[j]), int(seg.hi[j])
                    if f == TEXT:
                        row = (int(seg.key[j].astype(np.int64)), int(ids[i]), int(versions[i]), lo - int(off[i]), hi - lo + 1, int(seg.at[j]) - lo, raw[lo : hi + length])
                        for col, v in zip(out, row, strict=True):
                            col.append(v)
                    elif f == SPREAD:
                        h = seg.hashes(np.arange(lo, hi + 1), np.arange(lo, hi + 1) + length, np.zeros(hi - lo + 1)).astype(np.int64)
                        hot += [(int(ids[i]), int(versions[i]), s - int(off[i]), int(x), int(seg.at[j]) - s, raw[s : s + length]) for x, s in zip(h, range(lo, hi + 1), strict=True)]
            first, known = set(), []
            for doc, version, start, x, anchor, passage in sorted(hot):
                if passage not in first:
                    first.add(passage)
                    row = (x, doc, version, start, 1, anchor, passage)
                elif known and known[-1][:2] == [doc, version] and known[-1][2] + known[-1][3] == start:
                    known[-1][3] += 1
                    continue
                else:
                    known.append([doc, version, start, 1])
                    continue
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            for doc, version, start, n in known:
                for col, v in zip(out, (doc ^ version, doc, version, start, n, -1, b""), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["bucket", "doc_id", "version", "lo", "n", "anchor", "bytes"])

    @common.tidy
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come whole and in order; blocks of whole buckets are sorted, one after the other."""

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            bucket, doc, version, lo, n, anchor = (t.column(i).to_numpy() for i in range(6))
            row = np.repeat(np.arange(len(n)), n)
            hit = (anchor < 0)[row]
            sorted_ = np.flatnonzero(anchor >= 0)
            if len(sorted_):
                hit[~hit] = repeated(bucket[sorted_], t.column(6).take(pa.array(sorted_)).to_pylist(), anchor[sorted_].astype(np.int64), n[sorted_].astype(np.int64), length)
            rel = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            at = lo[row] + rel
            hits = np.flatnonzero(hit)
            if not len(hits):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["doc_id", "version", "starts"])
            order = hits[np.lexsort((at[hits], version[row[hits]], doc[row[hits]]))]
            d, v, p = doc[row[order]], version[row[order]], at[order]
            # runs of starts
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
            ends = np.append(cut[1:], len(d))
            blobs = []
            for a, z in zip(cut, ends, strict=True):
                own_p = p[a:z]
                new = np.flatnonzero(np.append(True, own_p[1:] != own_p[:-1] + 1))
                blobs.append(_blob(own_p[new].astype(np.uint32), own_p[np.append(new[1:], len(own_p)) - 1].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(v[cut]), pa.array(blobs, pa.binary())], names=["doc_id", "version", "starts"])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(0).to_numpy()
            new = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            if held and bucket[0] != held[-1].column(0)[-1].as_py():
                new = np.append(0, new)
            last = 0
            for z in new:
                if size + (z - last) * 140 >= BLOCK:
                    held.append(b.slice(last, z - last))
                    yield block([x for x in held if x.num_rows])
                    held, size, last = [], 0, z
            held.append(b.slice(last))
            size += (b.num_rows - last) * 140
        if held:
            yield block([x for x in held if x.num_rows])

    dealt = marked.where("flags is not null").mapInArrow(segments, "bucket long, doc_id long, version long, lo int, n int, anchor int, bytes binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "version", "lo")
    starts = dealt.mapInArrow(sort, "doc_id long, version long, starts binary").groupBy("doc_id", "version").agg(F.collect_list("starts").alias("starts"))
    return marked.join(starts, ["doc_id", "version"], "left").select("doc_id", "version", "text", "flags", "starts", *extra)


def _covered(i: int, seg: Anchors, begins: np.ndarray, off: np.ndarray, flags, starts, length: int) -> list[tuple[int, int]]:
    """Removed runs (begin, end) of document i of a batch, in bytes of the document."""
    at, flag = _flags(flags)
    whole = (at + begins[i])[flag == SAME]
    lo, hi = seg.lo[whole] - off[i], seg.hi[whole] - off[i]
    for x in starts or ():
        a, z = _unblob(x, np.uint32, np.uint32)
        lo, hi = np.append(lo, a), np.append(hi, z)
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64)) + length
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts earlier (smaller id, or earlier in the document).

    Returns doc_id, version (a hash of the text), n_bytes, n_removed, n_spans, kept binary and
    removed array<struct<begin, end>>, a row for each row of docs. Null texts count as empty; a null
    id comes before all others; of rows that repeat an id, other texts come by their hash, and rows
    that repeat id and text are one document and get the same result. Columns named in `carry` come
    out again as the struct `extra`, so no join is needed to find them; others are ignored.
    """
    marked = removed_ranges(docs, length, k, id_col, text_col, carry)
    @common.tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
        for b in common.pieces(batches, "text", PIECE):
            flags, starts = b.column(3).to_pylist(), b.column(4).to_pylist()
            some = [i for i in range(b.num_rows) if flags[i] or starts[i]]
            seg, _, begins, own_off = _own_segments(b.take(pa.array(some, pa.int64())), length, k)
            runs_of = {i: _covered(j, seg, begins, own_off, flags[i], starts[i], length) for j, i in enumerate(some)}
            data, off = common.text_bytes(b.column(2))
            raw = data.tobytes()
            kept, spans = [], []
            for i in range(b.num_rows):
                runs = runs_of.get(i, [])
                text, last, parts = raw[off[i] : off[i + 1]], 0, []
                for a, z in runs:
                    parts.append(text[last:a])
                    last = z
                kept.append(b"".join([*parts, text[last:]]))
                spans.append([{"begin": a, "end": z} for a, z in runs])
            n = np.diff(off)
            left = np.array([len(x) for x in kept])
            none = -(1 << 63)
            ids = pa.array([None if x == none else x for x in b.column(0).to_pylist()], pa.int64())
            cols = [ids, b.column(1), pa.array(n), pa.array(n - left), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(span)), *b.columns[5:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "version", "n_bytes", "n_removed", "n_spans", "kept", "removed", "extra"][: len(cols)])

    schema = T.StructType.fromDDL("doc_id long, version long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<begin:int,end:int>>")
    return marked.mapInArrow(finish, schema.add("extra", marked.schema["extra"].dataType) if carry else schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(0, octet_length(b) - {LENGTH - 1}), lambda s: {{'s': s, 'g': md5(b[s + 1:s + {LENGTH}])}})) AS x FROM d WHERE octet_length(b) >= {LENGTH}),
g AS (SELECT doc_id, x.s AS s, row_number() OVER (PARTITION BY x.g ORDER BY doc_id, x.s) AS k FROM w),
p AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM g WHERE k > 1),
q AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM p),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + {LENGTH} AS z FROM q GROUP BY doc_id, run),
f AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT f.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS head
      FROM f JOIN d USING (doc_id) GROUP BY f.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1:]))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
