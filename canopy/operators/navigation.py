"""Steps along a tree as joins, and probes as semi, anti and aggregating joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.values import NODE


def node_columns(nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """nodes with the columns of a variable, and `more` of its own under the same prefix."""
    return nodes.select(*[F.col(c).alias(f"{name}__{c}") for c in ("doc_id", *NODE, *more)])


def step(env: DataFrame, nodes: DataFrame, base: str, name: str, axis: str, field: str | None = None, kind: str | None = None) -> DataFrame:
    """Each row of env with each node that `axis` (child, descendant or field) reaches from the node `base`, as the node `name`.

    Kind and field tests go to the scan of nodes. The order column gets the node's place.
    """
    reached = nodes
    if axis == "field":
        reached = reached.where(F.col("field") == field)
    else:
        reached = reached.where("is_named")
    if kind is not None:
        reached = reached.where(F.col("is_named") & (F.col("kind") == kind))
    c = lambda n, f: F.col(f"{n}__{f}")
    if axis == "descendant":
        there = node_columns(reached, name)
        near = (c(name, "node_id") > c(base, "node_id")) & (c(name, "node_id") <= c(base, "last_desc"))
    else:
        there = node_columns(reached, name, "parent_id")
        near = c(name, "parent_id") == c(base, "node_id")
    out = env.join(there, (F.col("doc_id") == c(name, "doc_id")) & near)
    return out.withColumn("__ord", F.concat("__ord", F.array(c(name, "node_id")))).drop(f"{name}__doc_id", f"{name}__parent_id")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal documents, and equal keys where null equals null; right's keys carry the prefix k__."""
    tests = [F.col("doc_id") == F.col("k__doc_id")]
    tests += [F.col(k).eqNullSafe(F.col(f"k__{k}")) if k in left.columns else F.lit(True) for k in keys]
    return reduce(lambda a, b: a & b, tests)


def keys_of(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(F.col("doc_id").alias("k__doc_id"), *[F.col(k).alias(f"k__{k}") for k in keys])


def probe(env: DataFrame, found: DataFrame, keys: list[str], exists: bool) -> DataFrame:
    """Rows of env that some row of found (or none) shares the keys with."""
    return env.join(keys_of(found, keys), same_keys(env, found, keys), "left_semi" if exists else "left_anti")


def collect(env: DataFrame, found: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """env with the list of found's values that share the keys, in order; an empty list where there are none."""
    lists = found.withColumn("__value", value).groupBy("doc_id", *keys).agg(F.sort_array(F.collect_list(F.struct("__ord", "__value"))).alias("__list"))
    lists = lists.select(F.col("doc_id").alias("k__doc_id"), *[F.col(k).alias(f"k__{k}") for k in keys], F.transform("__list", lambda x: x["__value"]).alias(name))
    out = env.join(lists, same_keys(env, lists, keys), "left").drop("k__doc_id", *[f"k__{k}" for k in keys])
    empty = F.array().cast(lists.schema[name].dataType)
    return out.withColumn(name, F.coalesce(name, empty))
