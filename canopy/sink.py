"""Where results go: JSON lines of a file's values, one object for a run, or plain text."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.engine import CompiledQuery


def write_json(query: CompiledQuery, nodes: DataFrame, path: str) -> None:
    """A line of JSON for each document with results, written by the executors."""
    query.envelope(nodes).select(F.col("json").alias("value")).write.text(path)


def document(query: CompiledQuery, nodes: DataFrame, read_time_ns: int = 0) -> str:
    """{"results": [...], "stats": {...}} of a run that is small enough for one string; files without results are left out.

    Reading was timed by the caller; parsing and the query are timed here.
    """
    began = time.perf_counter_ns()
    nodes = nodes.cache()
    nodes.count()
    parsed = time.perf_counter_ns()
    lines = [r.json for r in query.envelope(nodes).orderBy("doc_id").toLocalIterator()]
    done = time.perf_counter_ns()
    nodes.unpersist()
    stats = {"read_time_ns": read_time_ns, "parse_time_ns": parsed - began, "query_time_ns": done - parsed}
    return '{"results":[' + ",".join(lines) + '],"stats":' + json.dumps(stats) + "}"


def values(query: CompiledQuery, nodes: DataFrame) -> str:
    """{"values": [...]} of a single document."""
    rows = query.run_json(nodes).orderBy("doc_id", "__ord").toLocalIterator()
    return '{"values":[' + ",".join(r.value for r in rows) + "]}"
