"""From raw documents to packed sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm import common, jaccard, packing, pii, rules, substrings


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; boilerplate lines leave the texts of the others.

    Null and empty texts fail; a null source is a host of its own, null ids and repeated rows are
    judged each for itself, other columns stay as they are.
    """
    return _counted(rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays: the one with the smallest id and, of that id, the text of least hash.

    Of repeated rows of that document one stays. A null id counts as the largest; texts that are null,
    empty or without words all stay, as they are; an empty table stays empty.
    """
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    row = common.unused(docs, "row")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.col("text_hash"))
    stay = jaccard.join(docs).where("first and n_shingles > 0").select(key.alias(row)).distinct()
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    kept = docs.where(~wordless).withColumn(row, own).join(stay, row, "left_semi").dropDuplicates([row]).drop(row)
    return kept.unionByName(docs.where(wordless))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier go from the texts, with what is left of a character cut in two; documents of which nothing is left go.

    Null and empty texts stay, as empty ones; a null id comes before all others; repeated rows count
    as one document, so they all lose the same passages; other columns stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    done = substrings.dedup(docs, carry=tuple(others)).where("n_removed < n_bytes or n_bytes = 0")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("extra", done.schema["extra"].dataType)])
    cut = done.select("kept", "extra").mapInArrow(_decoded, schema)
    return _counted(cut.select(*[F.col("text") if c == "text" else F.col("extra").getField(c).alias(c) for c in docs.columns]))


def _decoded(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "ignore") for x in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["text", "extra"])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kinds; null texts stay null, every row stays, other columns stay as they are."""
    return _counted(pii.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences; null and empty texts give the end id alone, repeated rows are packed each, null ids stay."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packed),
]

#: Tokenizers and regular expressions over normalised texts have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs)
    return docs
