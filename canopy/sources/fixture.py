"""Trees written by hand as s-expressions over a source text, for languages without a parser here."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from canopy.sources.parse import Builder
from canopy.sources.trees import SCHEMA

_PART = re.compile(r"\s*(?:(?P<field>\w+):)?(?:\((?P<kind>\w+)(?:\s*\"(?P<text>(?:[^\"\\]|\\.)*)\")?|(?P<close>\)))")


def nodes_of(text: str, tree: str) -> list[tuple]:
    """Nodes of a tree such as (program (class_declaration "class A {}" name:(type_identifier "A"))).

    A node's text is looked for in the source from its parent's begin on, after the siblings that
    went before; a node without a text covers its parent's.
    """
    b = Builder(text)
    at, spans = 0, [[0, len(b.data), 0]]
    while at < len(tree.rstrip()):
        m = _PART.match(tree, at)
        if not m:
            raise ValueError(tree[at : at + 20])
        at = m.end()
        if m["close"]:
            spans.pop()
            b.finish()
            continue
        outer = spans[-1]
        begin, end = outer[:2]
        if m["text"] is not None:
            part = m["text"].replace('\\"', '"').encode()
            begin = b.data.find(part, outer[2], outer[1])
            if begin < 0:
                raise ValueError(m["text"])
            end = begin + len(part)
            outer[2] = end
        b.begin(m["kind"], begin, end, m["field"])
        spans.append([begin, end, begin])
    return list(b.nodes())


def fixture(spark: SparkSession, trees: dict[int, tuple[str, str]]) -> DataFrame:
    """nodes of {doc_id: (text, tree)}."""
    rows = [(k, *n) for k, (text, tree) in trees.items() for n in nodes_of(text, tree)]
    return spark.createDataFrame(rows, SCHEMA)
