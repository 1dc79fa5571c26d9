"""Values of tree queries as columns: what they are, how they are written as JSON and as plain text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.errors import UnsupportedQueryError

#: What a variable knows of its node, besides the document.
NODE = ("node_id", "last_desc", "kind", "text", "start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col")


@dataclass(frozen=True)
class Value:
    """A value of an environment row.

    form is node, string, uint, nothing, regex, list, record or tuple. A node has its columns under
    `name`; others have one column. parts: of a list the element, of a tuple the items, of a record
    the (key, value) pairs; inside those, columns are fields of the struct that holds them.
    """

    form: str
    name: str = ""
    parts: tuple = ()
    constant: object = None


def node_struct(name: str) -> Column:
    """The six fields of a node result; null if there is no node."""
    c = lambda f: F.col(f"{name}__{f}")
    point = lambda row, col: F.struct(c(row).alias("row"), c(col).alias("column"))
    six = F.struct(c("kind").alias("kind"), c("text").alias("text"), c("start_byte").alias("start_byte"), c("end_byte").alias("end_byte"), point("start_row", "start_col").alias("start_point"), point("end_row", "end_col").alias("end_point"))
    return F.when(c("node_id").isNotNull(), six)


def materialised(v: Value) -> Column:
    """One column with all of the value."""
    match v.form:
        case "node":
            return node_struct(v.name)
        case "string" | "uint":
            return F.lit(v.constant)
        case "nothing":
            return F.lit(None).cast("string")
        case "regex":
            raise UnsupportedQueryError("a regular expression is no result")
        case "record":
            return F.struct(*[materialised(x).alias(k) for k, x in v.parts]) if v.parts else F.struct(F.lit(None).cast("string").alias("_"))
        case "tuple":
            return F.struct(*[materialised(x).alias(f"_{i}") for i, x in enumerate(v.parts)]) if v.parts else F.struct(F.lit(None).cast("string").alias("_"))
    return F.col(v.name)


def quoted(c: Column) -> Column:
    """A string column as a JSON string; null stays null."""
    listed = F.to_json(F.array(c))
    return F.when(c.isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))


def as_json(v: Value, c: Column) -> Column:
    """The JSON text of a materialised value; records have their keys in order, tuples and lists are arrays."""
    null = F.lit("null")
    match v.form:
        case "node":
            return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), null)
        case "uint":
            return F.coalesce(c.cast("string"), null)
        case "string":
            return F.coalesce(quoted(c), null)
        case "nothing":
            return null
        case "list":
            return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: as_json(v.parts[0], x)), ","), F.lit("]")), null) if v.parts[0].form != "nothing" else F.lit("[]")
        case "tuple":
            return F.concat(F.lit("["), F.concat_ws(",", *[as_json(x, c[f"_{i}"]) for i, x in enumerate(v.parts)]), F.lit("]"))
        case "record":
            return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), as_json(x, c[k])) for k, x in sorted(v.parts)]), F.lit("}"))
    raise UnsupportedQueryError(f"{v.form} is no result")


def as_text(v: Value, c: Column) -> Column:
    """A short plain text of a materialised value: kind:text, [a|b], (a|b), {key=value;...}."""
    null = F.lit("null")
    match v.form:
        case "node":
            return F.coalesce(F.concat(c["kind"], F.lit(":"), F.coalesce(c["text"], F.lit(""))), null)
        case "uint" | "string":
            return F.coalesce(c.cast("string"), null)
        case "nothing":
            return null
        case "list":
            return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: as_text(v.parts[0], x)), "|"), F.lit("]")), null)
        case "tuple":
            return F.concat(F.lit("("), F.concat_ws("|", *[as_text(x, c[f"_{i}"]) for i, x in enumerate(v.parts)]), F.lit(")"))
        case "record":
            return F.concat(F.lit("{"), F.concat_ws(";", *[F.concat(F.lit(f"{k}="), as_text(x, c[k])) for k, x in sorted(v.parts)]), F.lit("}"))
    raise UnsupportedQueryError(f"{v.form} is no result")


#: Constructs that backtracking matchers with other engines know but the JVM's does not.
_FOREIGN = re.compile(r"\(\?(?:R|[0-9]|&|P>|\||\()|\\K|\(\*[A-Z]")


def checked_regex(pattern: str) -> str:
    """The pattern, if its constructs mean the same in the JVM; what does not is refused, not translated."""
    if m := _FOREIGN.search(pattern):
        raise UnsupportedQueryError(f"{m[0]} in a regular expression")
    return pattern
