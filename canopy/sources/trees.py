"""Trees from relational tables, one row a node, ids in pre-order by rule, made with one pass over each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITIONS = ("start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col")
SCHEMA = (
    "doc_id long, node_id int, parent_id int, last_desc int, kind string, field string, is_named boolean, text string, "
    "start_byte int, end_byte int, start_row int, start_col int, end_row int, end_col int"
)


def _node(node_id: Column, parent: Column | int | None, last: Column, kind: str, text: Column | str = "", field: str | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [("node_id", node_id, "int"), ("parent_id", as_column(parent), "int"), ("last_desc", last, "int"), ("kind", F.lit(kind), "string"), ("field", F.lit(field), "string"), ("is_named", F.lit(True), "boolean"), ("text", as_column(text), "string")]
    return F.struct(*[v.cast(t).alias(n) for n, v, t in values], *[F.lit(0).alias(p) for p in POSITIONS])


def _exploded(rows: DataFrame, doc: Column, nodes: Column) -> DataFrame:
    return rows.select(doc.cast("long").alias("doc_id"), F.explode(nodes).alias("n")).select("doc_id", "n.*")


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines: order (status, priority) > lineitem (flag, linestatus, qty)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)))

    def of_line(x: Column, k: Column) -> Column:
        at = 3 + 4 * k
        return F.array(
            _node(at, 0, at + 3, "lineitem"),
            _node(at + 1, at, at + 1, "return_flag", x["l_returnflag"], "flag"),
            _node(at + 2, at, at + 2, "line_status", x["l_linestatus"], "linestatus"),
            _node(at + 3, at, at + 3, "quantity", x["l_quantity"].cast("long").cast("string"), "qty"),
        )

    head = F.array(
        _node(F.lit(0), None, 2 + 4 * F.col("n"), "order"),
        _node(F.lit(1), 0, F.lit(1), "order_status", F.col("o_orderstatus"), "status"),
        _node(F.lit(2), 0, F.lit(2), "order_priority", F.col("o_orderpriority"), "priority"),
    )
    more = F.when(F.col("lines").isNotNull(), F.flatten(F.transform("lines", of_line)))
    return _exploded(joined, F.col("o_orderkey"), F.when(more.isNull(), head).otherwise(F.concat(head, more)))


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions: region (name) > nation (name) > customer (name, segment). Ids run in pre-order by key."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # a customer takes three ids, a nation two besides its customers, a region two
    counted = nation.join(customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", "n_regionkey", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.coalesce(F.sum(2 + 3 * F.col("n")).over(Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("at", 2 + before)
    size = placed.groupBy("n_regionkey").agg(F.sum(2 + 3 * F.col("n")).alias("size"))
    top = region.join(size, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    regions = _exploded(top, F.col("r_regionkey"), F.array(_node(F.lit(0), None, 1 + F.coalesce("size", F.lit(0)), "region"), _node(F.lit(1), 0, F.lit(1), "region_name", F.col("r_name"), "name")))
    nations = _exploded(placed, F.col("n_regionkey"), F.array(_node(F.col("at"), 0, F.col("at") + 1 + 3 * F.col("n"), "nation"), _node(F.col("at") + 1, F.col("at"), F.col("at") + 1, "nation_name", F.col("n_name"), "name")))
    ranked = customer.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).join(placed, F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.col("at") + 2 + 3 * (F.col("k") - 1)
    customers = _exploded(ranked, F.col("n_regionkey"), F.array(_node(own, F.col("at"), own + 2, "customer"), _node(own + 1, own, own + 1, "customer_name", F.col("c_name"), "name"), _node(own + 2, own, own + 2, "segment", F.col("c_mktsegment"), "segment")))
    return regions.unionByName(nations).unionByName(customers)


def conv_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: conversation > turn (role, content), in the order of turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def of_turn(x: Column, k: Column) -> Column:
        at = 1 + 3 * k
        return F.array(_node(at, 0, at + 2, "turn"), _node(at + 1, at, at + 1, "role", x["role"], "role"), _node(at + 2, at, at + 2, "content", x["text"], "content"))

    head = F.array(_node(F.lit(0), None, 3 * F.size("turns"), "conversation"))
    return _exploded(turns, F.col("conv_id"), F.concat(head, F.flatten(F.transform("turns", of_turn))))


def user_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: user > event (type, props), by time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type", "props"))).alias("events"))

    def of_event(x: Column, k: Column) -> Column:
        at = 1 + 3 * k
        return F.array(_node(at, 0, at + 2, "event"), _node(at + 1, at, at + 1, "event_type", x["event_type"], "type"), _node(at + 2, at, at + 2, "props", x["props"], "props"))

    head = F.array(_node(F.lit(0), None, 3 * F.size("events"), "user"))
    return _exploded(events, F.col("user_id"), F.concat(head, F.flatten(F.transform("events", of_event))))


def doc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: document (lang, source) > line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    head = F.array(_node(F.lit(0), None, 2 + F.size("lines"), "document"), _node(F.lit(1), 0, F.lit(1), "lang", F.col("lang"), "lang"), _node(F.lit(2), 0, F.lit(2), "source", F.col("source"), "source"))
    return _exploded(docs, F.col("doc_id"), F.concat(head, F.transform("lines", lambda x, k: _node(3 + k, 0, 3 + k, "line", x))))
