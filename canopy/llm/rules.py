"""Quality rules: lines that too many documents of a host share go, and documents that little is left of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common

#: A line is boilerplate of its host from so many different documents on ...
LEAST_DOCS = 20
#: ... if they are so large a share of the host's different documents.
SHARE = 0.05
#: A document is depleted if more than so much of its words stands in boilerplate lines.
DEPLETED = 0.75

SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """A-Z in lower case, each digit as 0, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER + "123456789", LOWER + "0" * 9), SPACE + "+", " "))


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: how many of the words stand in a window of three words that is found twice or more.

    Windows are hashed; hash and place are sorted as one number (as a pair from 2^22 words on), and
    places of windows equal to a neighbour are repeats. Each step is a column of its own: a lambda
    that refers to a longer expression would evaluate that anew for each element.
    """
    n, mask = F.size("words"), (1 << 22) - 1
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    starts = F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0)))
    df = df.withColumn("__starts", starts)
    df = df.withColumn("__packed", F.when(n < mask, F.sort_array(F.transform("__starts", lambda w, i: window(w, i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))))
    df = df.withColumn("__pairs", F.when(n >= mask, F.sort_array(F.transform("__starts", lambda w, i: F.struct(window(w, i).alias("h"), i.cast("long").alias("i"))))))
    near = lambda a, b: F.coalesce(F.shiftright(a.bitwiseXOR(b), 22) == 0, F.lit(False))
    few = F.transform(F.filter("__packed", lambda x, i: near(x, F.get("__packed", i + 1)) | near(x, F.get("__packed", i - 1))), lambda x: x.bitwiseAND(F.lit(mask)))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    many = F.transform(F.filter("__pairs", lambda x, i: same(x, F.get("__pairs", i + 1)) | same(x, F.get("__pairs", i - 1))), lambda x: x["i"])
    df = df.withColumn("__at", F.coalesce(few, many))
    covered = F.array_distinct(F.concat("__at", F.transform("__at", lambda i: i + 1), F.transform("__at", lambda i: i + 2)))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long"))


def measures(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row a document: the base measures and the normalised lines' hashes and words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    base = base.withColumn("words", words_of(F.col("text"))).withColumn("rows", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return with_repeated_words(base).select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("rows") - F.size(F.array_distinct("rows"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("rows", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).alias("w"))).alias("lines"),
    )


def boilerplate(base: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(host, common array<long>): hashes of lines that too many different documents of a host have.

    Documents with equal texts count once, or every line of a document with many copies would be
    boilerplate and all the copies would go. A host has at most (lines of a document on average) /
    share such lines, so the arrays do not grow with the host.
    """
    docs = base.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    lines = base.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    counted = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    return counted.join(docs, "host").where(F.col("n") >= share * F.col("docs")).groupBy("host").agg(F.collect_list("h").alias("common"))


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_docs: int = LEAST_DOCS,
    share: float = SHARE,
    depleted: float = DEPLETED,
) -> DataFrame:
    """Measures and verdict of every document, a row for each row of df.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_common_words (words in boilerplate lines) and common (hashes of its own such lines, null if
    the host has none). Null texts count as empty, a null host is a host of its own name '', null ids stay;
    rows that repeat a text count as one document of a line; other columns are not looked at.
    """
    # written once: lines are counted, and then looked up, from the same measures
    base = common.cut(measures(df, id_col, text_col, host_col))
    found = boilerplate(base, least_docs, share)
    # a host's lines are 1 / share times those of a document at most: some kilobytes
    out = common.lookup(base, found, "host", few=1000).withColumn("boiler", F.when(F.col("common").isNotNull(), F.filter("lines", lambda x: F.array_contains(F.col("common"), x["h"]))))
    out = out.withColumn("n_common_words", F.coalesce(F.aggregate("boiler", F.lit(0), lambda s, x: s + x["w"]), F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    verdict = ~F.col("base_failed") & (F.col("n_common_words") <= depleted * F.col("n_words"))
    return out.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "n_common_words", F.array_distinct(F.transform("boiler", lambda x: x["h"])).alias("common"))


def clean(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", **limits) -> DataFrame:
    """The rows of df that are kept, with boilerplate lines taken out of their texts; same columns.

    The verdict is found again by id and text, so rows that repeat an id with another text are judged each for itself.
    """
    id_, hash_, lines = (common.unused(df, x) for x in ("id", "hash", "common"))
    # written first: a filter pushed below the measures would have each of their steps evaluated over and over
    kept = common.cut(judge(df, id_col, text_col, host_col, **limits)).where("kept")
    kept = kept.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.when(F.col("n_common_words") > 0, F.col("common")).alias(lines)).dropDuplicates([id_, hash_])
    own = df.withColumn(id_, F.col(id_col).cast("long")).withColumn(hash_, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    joined = own.alias("d").join(kept.alias("k"), F.col(f"d.{id_}").eqNullSafe(F.col(f"k.{id_}")) & (F.col(f"d.{hash_}") == F.col(f"k.{hash_}")))
    text, listed = F.col(f"d.`{text_col}`"), F.col(f"k.{lines}")
    less = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(listed, F.xxhash64(normal_line(x)))), "\n")
    return joined.select(*[F.when(listed.isNotNull(), less).otherwise(text).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("text_hash", "common")


_SQL_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '{_SQL_WORD}') AS words FROM d),
g AS (SELECT k, len(words) AS n, unnest(range(1, greatest(len(words) - 1, 1))) AS i, words FROM w),
t AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2]) AS c FROM g),
r AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM t WHERE c > 1) GROUP BY k),
l AS (SELECT k, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT *, len(regexp_extract_all(line, '{_SQL_WORD}')) AS nw,
        trim(regexp_replace(translate(line, '{UPPER}123456789', '{LOWER}{"0" * 9}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM m GROUP BY k),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
freq AS (SELECT m.host, norm FROM m JOIN hosts h ON h.host = m.host GROUP BY m.host, norm, h.docs
         HAVING count(DISTINCT text) >= {LEAST_DOCS} AND count(DISTINCT text) >= {SHARE} * h.docs),
com AS (SELECT m.k, sum(nw) AS n_common_words FROM m JOIN freq f ON f.host = m.host AND f.norm = m.norm GROUP BY m.k),
b AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_common_words, 0) AS BIGINT) AS n_common_words
      FROM d JOIN w USING (k) LEFT JOIN r USING (k) LEFT JOIN dup USING (k) LEFT JOIN com USING (k)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_common_words <= {DEPLETED} * n_words) AS kept, n_common_words
FROM f
"""
