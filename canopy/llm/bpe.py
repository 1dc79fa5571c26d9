"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common, tokens


def characters(table: tokens.Bytes, ids: np.ndarray, off: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the characters of its text that its bytes belong to, (start, end), and whether it begins within one.

    `data` and `at` are the decoded bytes of all texts and where each text's begin and end.
    """
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.cumsum(table.size[ids])
    begins = ends - table.size[ids]
    within = data[begins] & 0xC0 == 0x80
    before = np.repeat(tokens.char_spans(data, at[:-1]), np.diff(off))
    return tokens.char_spans(data, begins) - within - before, tokens.char_spans(data, ends) - before, within


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Encode every text by the ranks in `path`, each match of `pattern` on its own, without special tokens.

    Returns (doc_id, ids array<int>) and, with `offsets`, char_start and char_end: the characters
    of the text that a token's bytes belong to. A character whose bytes are spread over several
    tokens counts for each of them. Null and empty texts give empty arrays; a null id stays null;
    repeated rows and ties are encoded each for itself; other columns are not looked at.
    """
    ids_t, off_t = pa.list_(pa.int32()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.lent(path, pattern) as enc:
            table = tokens.Bytes(enc.tok)
            for b in common.pieces(batches, "text"):
                texts = b.column(1).to_pylist()
                ids, off = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                cols = [b.column(0), lists]
                if offsets:
                    data, at = table.decode(ids, off)
                    start, last, _ = characters(table, ids, off, data, at)
                    cols += [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x.astype(np.int32))) for x in (start, last)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "char_start", "char_end"][: len(cols)])

    schema = "doc_id long, ids array<int>" + ", char_start array<int>, char_end array<int>" * offsets
    assert ids_t == off_t
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Turn (doc_id, ids) back into (doc_id, bytes binary): the byte table reversed, characters whose bytes lie in several tokens put together again.

    Null or empty ids give no bytes; a null id of a row is kept, and repeated rows are decoded each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.Bytes(tokens.encoder(path, pattern).tok)
        for b in batches:
            out = []
            for ids in b.column(1).to_pylist():
                x = np.asarray(ids or [], np.int64)
                out.append(table.decode(x, np.array([0, len(x)]))[0].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; one row a document with counts and SHA-256 digests.

    n_split counts the tokens that begin within a character; offsets_crc32 is the CRC-32 of all
    (char_start, char_end) as little-endian 32-bit numbers, as `encode` gives them. Null texts count
    as empty; each row of the input gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.lent(path, pattern) as enc:
            table = tokens.Bytes(enc.tok)
            for b in common.pieces(batches, "text", 2 << 20):
                ids, off = enc.encode(b.column(1).to_pylist())
                data, at = table.decode(ids, off)
                raw, text = memoryview(ids.astype("<u4").view(np.uint8)), memoryview(data)
                spans, chars = off.tolist(), at.tolist()
                start, last, within = characters(table, ids, off, data, at)
                places = memoryview(np.stack([start, last], 1).astype("<u4").reshape(-1).view(np.uint8))
                split = np.concatenate([[0], np.cumsum(within)])
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.diff(off), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * spans[i] : 4 * spans[i + 1]]).hexdigest() for i in range(n)]),
                        pa.array([hashlib.sha256(text[chars[i] : chars[i + 1]]).hexdigest() for i in range(n)]),
                        pa.array(np.diff(split[off]), pa.int64()),
                        pa.array([zlib.crc32(places[8 * spans[i] : 8 * spans[i + 1]]) for i in range(n)], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_crc32"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_crc32 long"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
