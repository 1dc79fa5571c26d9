"""The host interface: compile a query once, run it over any table of nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.errors import UnsupportedQueryError
from canopy.functions.values import Value, as_json, as_text, materialised, quoted
from canopy.plans import lower, syntax


@dataclass(frozen=True)
class CompiledQuery:
    """A parsed query with its semantics."""

    source: syntax.SourceFile
    semantics: str = lower.COMPAT

    @property
    def body(self) -> syntax.Body:
        items = list(self.source.items)
        if self.semantics == lower.DENOTATIONAL:
            while items and (isinstance(items[0], syntax.Directive) and items[0].kind == "language" or isinstance(items[0], syntax.QueryDefinition) and any(isinstance(x, syntax.Body) for x in items)):
                items.pop(0)
        first = items[0]
        if isinstance(first, syntax.Directive):
            raise UnsupportedQueryError(f"#{first.kind}")
        return first.body if isinstance(first, syntax.QueryDefinition) else first

    @property
    def language(self) -> str | None:
        return next((x.value for x in self.source.items if isinstance(x, syntax.Directive) and x.kind == "language"), None)

    def sexpr(self) -> str:
        return syntax.to_sexpr(self.source)

    def _with(self, nodes: DataFrame, render) -> DataFrame:
        planner = lower.Planner(nodes, self.semantics, {x.name: x for x in self.source.items if isinstance(x, syntax.QueryDefinition)})
        state, value = planner.run(self.body)
        column, value = _whole(value)
        return state.rows.select("doc_id", "__ord", column.alias("__value")).select("doc_id", "__ord", render(value, F.col("__value")).alias("value"))

    def run(self, nodes: DataFrame) -> DataFrame:
        """(doc_id, __ord, value): a row a result; __ord sorts the results of a document as the reference yields them."""
        return self._with(nodes, lambda v, c: c)

    def run_json(self, nodes: DataFrame) -> DataFrame:
        """As run, with the value as JSON text."""
        return self._with(nodes, as_json)

    def run_text(self, nodes: DataFrame) -> DataFrame:
        """(doc_id, value) with the value as a short plain text."""
        return self._with(nodes, as_text).drop("__ord")

    def explain(self, nodes: DataFrame) -> str:
        df = self.run(nodes)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def envelope(self, nodes: DataFrame) -> DataFrame:
        """(doc_id, json): the values of each document that has any, in order, as one JSON object with its file."""
        rows = self.run_json(nodes).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("__ord", "value"))).alias("all"))
        values = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["value"]), ","), F.lit("]"))
        return rows.select("doc_id", F.concat(F.lit('{"file":'), quoted(F.col("doc_id").cast("string")), F.lit(',"values":'), values, F.lit("}")).alias("json"))


def _whole(value: Value):
    """The column of a value, and the value that describes it."""
    return (F.col(value.name), value.constant) if value.form == "built" else (materialised(value), value)


class TreeEngine:
    """Compiles queries for a session."""

    def __init__(self, spark: SparkSession, semantics: str = lower.COMPAT) -> None:
        self.spark, self.semantics = spark, semantics
        # joins on (document, node) may use a partitioning by document alone
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def compile(self, text: str) -> CompiledQuery:
        return CompiledQuery(syntax.parse(text), self.semantics)

    def query(self, text: str, nodes: DataFrame) -> DataFrame:
        return self.compile(text).run(nodes)

    def with_semantics(self, semantics: str) -> TreeEngine:
        return TreeEngine(self.spark, semantics)


def limited(query: CompiledQuery, nodes: DataFrame, n: int) -> DataFrame:
    """The first n results in order."""
    return query.run(nodes).orderBy("doc_id", "__ord").limit(n)

