"""Trees that another program has parsed: printed s-expressions with points, beside their source texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.sources.parse import NAMES, Builder
from canopy.sources.trees import SCHEMA

#: A tree stands in a file named as its source with this added.
ENDING = ".tree"
# Fixed format: (kind [row, column] - [row, column] ...), children inside, a field's name and a colon before them.
_OPEN = re.compile(r"\s*(?:(?P<field>\w+):\s*)?\((?P<missing>MISSING\s+)?(?P<kind>\"(?:[^\"\\]|\\.)*\"|\w+)\s*\[(\d+),\s*(\d+)\]\s*-\s*\[(\d+),\s*(\d+)\]")
_CLOSE = re.compile(r"\s*\)")


def tree_nodes(text: str, tree: str) -> list[tuple]:
    """Nodes of a printed tree over its source text; columns of points are bytes. An empty tree has no nodes."""
    b = Builder(text)
    at, end = 0, len(tree.rstrip())
    while at < end:
        if m := _CLOSE.match(tree, at):
            if not b.open:
                raise ValueError(f"a bracket too many at {at}")
            b.finish()
        elif m := _OPEN.match(tree, at):
            rows = [int(m[k]) for k in (4, 5, 6, 7)]
            if max(rows[0], rows[2]) > len(b.line_starts):
                raise ValueError(f"no such row at {at}: {m[0].strip()}")
            # a node may end on the row after the last line break
            starts = [*b.line_starts, len(b.data)]
            b.begin(m["kind"].strip('"'), starts[rows[0]] + rows[1], starts[rows[2]] + rows[3], m["field"], not m["kind"].startswith('"'))
        else:
            raise ValueError(f"no node at {at}: {tree[at : at + 20]!r}")
        at = m.end()
    if b.open:
        raise ValueError("a bracket is not closed")
    return list(b.nodes())


def exported(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree_col: str = "tree") -> DataFrame:
    """Nodes of (doc_id, text, tree) rows, read where the rows are. Rows without a tree give no nodes; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                rows = [(i, *n) for i, text, tree in part.itertuples(index=False) for n in tree_nodes(text or "", tree or "")]
                out = pd.DataFrame(rows, columns=NAMES)
                out["parent_id"] = out["parent_id"].astype("Int32")
                yield out

    own = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(tree_col).cast("string").alias("tree"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, SCHEMA.replace("doc_id long", f"doc_id {kind}", 1))


def with_trees(texts: DataFrame, spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(doc_id, text, tree) of scanned files; paths are the folders, or the tree files themselves. A file with no tree file beside it has a null tree."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ENDING}")
    trees = reader.load(paths).select(F.expr(f"left(path, length(path) - {len(ENDING)})").alias("doc_id"), F.decode("content", "UTF-8").alias("tree"))
    return texts.join(trees, "doc_id", "left")

