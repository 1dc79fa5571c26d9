"""Trees from texts: web pages, Python source and s-expressions, parsed on the executors; and the file scan."""

from __future__ import annotations

import ast
import bisect
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.errors import UnsupportedQueryError
from canopy.sources.trees import SCHEMA

# File name endings by language.
SUFFIXES = {
    "c": (".c", ".h"),
    "cpp": (".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"),
    "go": (".go",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py",),
    "rust": (".rs",),
    "tsx": (".tsx", ".ts"),
    "typescript": (".ts",),
    "zig": (".zig",),
    "html": (".html", ".htm"),
}

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Builder:
    """Collects nodes in pre-order and fills in ids, offsets in bytes, rows and columns."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")
        self.line_starts = [0, *(i + 1 for i, b in enumerate(self.data) if b == 10)]
        self.rows: list[list] = []
        self.open: list[int] = []

    def begin(self, kind: str, start: int, end: int | None = None, field: str | None = None, named: bool = True) -> int:
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, None, kind, field, named, start, end])
        self.open.append(len(self.rows) - 1)
        return self.open[-1]

    def finish(self, end: int | None = None) -> None:
        row = self.rows[self.open.pop()]
        row[2] = len(self.rows) - 1
        if end is not None:
            row[7] = end

    def point(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.line_starts, at) - 1
        return line, at - self.line_starts[line]

    def nodes(self) -> Iterator[tuple]:
        for id_, parent, last, kind, field, named, start, end in self.rows:
            yield id_, parent, last, kind, field, named, self.data[start:end].decode("utf-8", "replace"), start, end, *self.point(start), *self.point(end)


def python_nodes(text: str) -> list[tuple]:
    """Nodes of Python source: kinds are the syntax classes, fields the attribute that a child stands in; names and constants are nodes of their own."""
    b = Builder(text)
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        b.begin("ERROR", 0, len(b.data))
        b.finish()
        return list(b.nodes())

    def span(x, outer: tuple[int, int]) -> tuple[int, int]:
        if getattr(x, "lineno", None) is None or getattr(x, "end_lineno", None) is None:
            return outer
        return starts[x.lineno - 1] + x.col_offset, starts[x.end_lineno - 1] + x.end_col_offset

    def visit(x, field: str | None, outer: tuple[int, int]) -> None:
        own = span(x, outer)
        b.begin(type(x).__name__, *own, field)
        for name, value in ast.iter_fields(x):
            for y in value if isinstance(value, list) else [value]:
                if isinstance(y, ast.AST):
                    if not isinstance(y, ast.expr_context):
                        visit(y, name, own)
                elif isinstance(y, str) and name in ("name", "id", "attr", "arg", "module"):
                    at = b.data.find(y.encode(), own[0], own[1])
                    at = own[0] if at < 0 else at
                    b.begin("identifier", at, at + len(y.encode()), name)
                    b.finish()
        b.finish()

    visit(tree, None, (0, len(b.data)))
    return list(b.nodes())


class _Page(HTMLParser):
    def __init__(self, b: Builder) -> None:
        super().__init__(convert_charrefs=False)
        self.b, self.names = b, ["document"]
        self.chars = [0]
        for line in b.text.split("\n"):
            self.chars.append(self.chars[-1] + len(line) + 1)
        b.begin("document", 0, len(b.data))
        ends, total = [0], 0
        for c in b.text:
            total += len(c.encode("utf-8", "surrogatepass"))
            ends.append(total)
        self.bytes_at = ends

    def here(self) -> int:
        line, col = self.getpos()
        return self.bytes_at[min(self.chars[line - 1] + col, len(self.bytes_at) - 1)]

    def handle_starttag(self, tag, attrs):
        at, raw = self.here(), self.get_starttag_text() or ""
        end = at + len(raw.encode("utf-8", "surrogatepass"))
        if tag in ("p", "li", "td", "tr") and self.names[-1] == tag:
            self.close(at)
        self.b.begin(tag, at, end)
        for name, value in attrs:
            self.b.begin("attribute_value", *self.value_span(raw, at, value or ""), name)
            self.b.finish()
        if tag in VOID:
            self.b.finish(end)
        else:
            self.names.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close(self.here() + len((self.get_starttag_text() or "").encode("utf-8", "surrogatepass")))

    def value_span(self, raw: str, at: int, value: str) -> tuple[int, int]:
        k = raw.find(value)
        k = 0 if k < 0 else k
        begin = at + len(raw[:k].encode("utf-8", "surrogatepass"))
        return begin, begin + len(value.encode("utf-8", "surrogatepass"))

    def close(self, end: int) -> None:
        self.names.pop()
        self.b.finish(end)

    def handle_endtag(self, tag):
        if tag not in self.names[1:]:
            return
        while self.names[-1] != tag:
            self.close(self.here())
        self.close(self.here() + len(tag) + 3)

    def handle_data(self, data):
        if data.strip():
            at = self.here()
            self.b.begin("text", at, at + len(data.encode("utf-8", "surrogatepass")))
            self.b.finish()


def page_nodes(text: str) -> list[tuple]:
    """Nodes of a web page: elements by tag, attribute values on fields of the attribute's name, texts; unclosed elements end where they have to."""
    b = Builder(text)
    page = _Page(b)
    page.feed(text)
    page.close_all = None
    try:
        HTMLParser.close(page)
    except AssertionError:
        pass
    while len(page.names) > 1:
        page.names.pop()
        b.finish(len(b.data))
    b.finish(len(b.data))
    return list(b.nodes())


PARSERS: dict[str, Callable[[str], list[tuple]]] = {"python": python_nodes, "html": page_nodes}
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def parsed(texts: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Nodes of every text; parsing runs where the texts are. Null texts parse as empty ones."""
    if language not in PARSERS:
        raise UnsupportedQueryError(f"no parser for {language} here; put a printed tree beside each file, or load a table of nodes")
    parse = PARSERS[language]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                rows = [(i, *n) for i, t in zip(part.iloc[:, 0], part.iloc[:, 1], strict=True) for n in parse(t or "")]
                out = pd.DataFrame(rows, columns=NAMES)
                out["parent_id"] = out["parent_id"].astype("Int32")
                yield out

    own = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, SCHEMA.replace("doc_id long", f"doc_id {kind}", 1))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "page_id", "html")


def matches_suffix(path: str, language: str) -> bool:
    return path.endswith(SUFFIXES[language])


def scan_files(spark: SparkSession, paths: list[str] | str, language: str, explicit: bool = False) -> DataFrame:
    """(doc_id, text) of files below directories, by the language's endings; `explicit` takes the given files whatever they are called."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not explicit:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(SUFFIXES[language]) + "}")
    files = reader.load(paths)
    return files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def source_tree(spark: SparkSession, paths: list[str] | str, language: str, explicit: bool = False) -> DataFrame:
    return parsed(scan_files(spark, paths, language, explicit), language)


def in_memory(spark: SparkSession, text: str, language: str) -> DataFrame:
    """The tree of one string."""
    return parsed(spark.createDataFrame([(0, text)], "doc_id long, text string"), language)
