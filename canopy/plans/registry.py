"""Tree queries by name, each with the SQL that gives the same rows over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.engine import TreeEngine
from canopy.sources import parse, trees

C, D = "compat", "denotational"


# The SQL reads the tables themselves, not nodes: each step of a query is a join of the tables that its tree is made of,
# and a value is its kind and text. So it owes nothing to the trees, and every join is one on plain keys.


def _v(kind: str, column: str = "''") -> str:
    return f"'{kind}:' || coalesce({column}, '')"


def _sql(root: str, value: str, *items: str, where: str = "TRUE") -> str:
    doc, table = root.split(" of ")
    return f"SELECT CAST({doc} AS BIGINT) AS doc_id, {value} AS value FROM {table} {' '.join(items)} WHERE {where}"


def _listed(name: str, key: str, value: str, order: str, table: str, where: str = "TRUE") -> str:
    """(key, xs): values by key in order, as one text."""
    return f"LEFT JOIN (SELECT {key}, string_agg({value}, '|' ORDER BY {order}) AS xs FROM {table} WHERE {where} GROUP BY {key}) {name} ON {name}.{key}"


def _record(**values: str) -> str:
    return "'{' || " + " || ';' || ".join(f"'{k}=' || {v}" for k, v in sorted(values.items())) + " || '}'"


ORDER, REGION, TURN, EVENT = "r.o_orderkey of orders r", "r.r_regionkey of region r", "t.conv_id of conversations t", "e.user_id of events e"
LINE = "JOIN lineitem l ON l.l_orderkey = r.o_orderkey"
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus"
NATION, CUSTOMER = "JOIN nation n ON n.n_regionkey = r.r_regionkey", "JOIN customer c ON c.c_nationkey = n.n_nationkey"
QTY_TEXT = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
LINE_V, FLAG_V, LINESTATUS_V, QTY_V = _v("lineitem"), _v("return_flag", "l_returnflag"), _v("line_status", "l_linestatus"), _v("quantity", QTY_TEXT)
STATUS_V, PRIORITY_V = _v("order_status", "r.o_orderstatus"), _v("order_priority", "r.o_orderpriority")
REGION_V, NATION_V, CUSTOMER_V, SEGMENT_V = _v("region_name", "r.r_name"), _v("nation_name", "n_name"), _v("customer_name", "c_name"), _v("segment", "c_mktsegment")
ALL_QTY, ALL_QTY_V = _listed("q", "l_orderkey", QTY_V, LINE_ORDER, "lineitem") + " = r.o_orderkey", "'[' || coalesce(q.xs, '') || ']'"
RETURNED, RETURNED_V = _listed("q", "l_orderkey", QTY_V, LINE_ORDER, "lineitem", "l_returnflag = 'R'") + " = r.o_orderkey", "'[' || coalesce(q.xs, '') || ']'"


def _with_line(test: str = "TRUE") -> str:
    """Whether the order has a line that passes the test."""
    return f"r.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL AND {test})"


#: name: (tree, query, SQL after the tree's WITH items, semantics).
QUERIES: dict[str, tuple[str, str, str, str]] = {
    "kind_test": ("order_tree", "with order as @o select @o", _sql(ORDER, _v("order")), C),
    "child_axis": ("order_tree", "with @root > lineitem as @l select @l", _sql(ORDER, LINE_V, LINE), C),
    "field_axis": ("order_tree", "with @root > lineitem as @l where @l.flag = 'R' select @l.qty", _sql(ORDER, QTY_V, LINE, where="l_returnflag = 'R'"), C),
    "field_multi": ("order_tree", "with @root > lineitem as @l select {flag: @l.flag, qty: @l.qty, status: @l.linestatus}", _sql(ORDER, _record(flag=FLAG_V, qty=QTY_V, status=LINESTATUS_V), LINE), C),
    "descendant_axis": ("order_tree", "with @root >> quantity as @q select @q", _sql(ORDER, QTY_V, LINE), C),
    "descendant_synonym": ("order_tree", "with @root descendant::quantity as @q select @q", _sql(ORDER, QTY_V, LINE), C),
    "descendant_then_child": ("geo_tree", "with @root >> nation as @n, @n > customer as @c select @c.segment", _sql(REGION, SEGMENT_V, NATION, CUSTOMER), C),
    "nav_chain": ("geo_tree", "with @root > nation > customer as @c select @c.name", _sql(REGION, CUSTOMER_V, NATION, CUSTOMER), C),
    "nav_parenthesised": ("geo_tree", "with (@root > nation) > customer as @c select (@c.name)", _sql(REGION, CUSTOMER_V, NATION, CUSTOMER), C),
    "field_after_child": ("geo_tree", "with @root > nation.name as @n select @n", _sql(REGION, NATION_V, NATION), C),
    "variable_alias": ("order_tree", "with @root > lineitem as @l, @l as @m select @m.qty", _sql(ORDER, QTY_V, LINE), C),
    "multi_binding_fanout": ("order_tree", "with @root > lineitem as @a, @root > lineitem as @b where @a.flag = 'R' select {a: @a.qty, b: @b.flag}", _sql(ORDER, _record(a=_v("quantity", QTY_TEXT.replace("l_q", "l.l_q")), b=_v("return_flag", "m.l_returnflag")), LINE, "JOIN lineitem m ON m.l_orderkey = l.l_orderkey", where="l.l_returnflag = 'R'"), C),
    "lazy_unreferenced_binding": ("order_tree", "with @root > lineitem as @l, @root.status as @s select @s", _sql(ORDER, STATUS_V), C),
    "eager_unreferenced_binding": ("order_tree", "with @root > lineitem as @l, @root.status as @s select @s", _sql(ORDER, STATUS_V, LINE), D),
    "where_eq_text": ("order_tree", "with @root.status as @s where @s = 'F' select @root.priority", _sql(ORDER, PRIORITY_V, where="r.o_orderstatus = 'F'"), C),
    "where_ne_text_compat": ("order_tree", "with @root.status as @s where @s != 'F' select @s", _sql(ORDER, STATUS_V, where="r.o_orderstatus = 'F'"), C),
    "where_ne_text_denotational": ("order_tree", "with @root.status as @s where @s != 'F' select @s", _sql(ORDER, STATUS_V, where="r.o_orderstatus <> 'F'"), D),
    "where_regex": ("order_tree", "with @root.priority as @p where @p ~ /^[12]-/ select @p", _sql(ORDER, PRIORITY_V, where="regexp_matches(r.o_orderpriority, '^[12]-')"), C),
    "where_not_regex": ("order_tree", "with @root.priority as @p where @p !~ /URGENT/ select @p", _sql(ORDER, PRIORITY_V, where="NOT regexp_matches(r.o_orderpriority, 'URGENT')"), C),
    "where_node_identity": ("order_tree", "with @root > lineitem as @a, @root > lineitem as @b where @a = @b select @a.qty", _sql(ORDER, QTY_V, LINE), C),
    "where_node_difference": ("order_tree", "with @root > lineitem as @a, @root > lineitem as @b where @a != @b select @b.flag", "SELECT doc_id, value FROM (" + _sql(ORDER, FLAG_V + " AS value, unnest(range(k.n - 1))", LINE, "JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) k ON k.l_orderkey = l.l_orderkey").replace(" AS value FROM", " AS i FROM") + ") x", C),
    "where_eq_null": ("order_tree", "with @root.status as @s where @s = null select @s", _sql(ORDER, STATUS_V, where="FALSE"), C),
    "where_ne_null": ("order_tree", "with @root.status as @s where @s != null select @s", _sql(ORDER, STATUS_V), C),
    "where_is_null": ("order_tree", "with order as @o where @o > lineitem is null select @o.status", _sql(ORDER, STATUS_V, where="NOT " + _with_line()), C),
    "where_is_not_null": ("order_tree", "with order as @o where @o > lineitem is not null select @o.status", _sql(ORDER, STATUS_V, where=_with_line()), C),
    "where_and": ("order_tree", "with @root > lineitem as @l where @l.flag = 'R' and @l.linestatus = 'F' select @l.qty", _sql(ORDER, QTY_V, LINE, where="l_returnflag = 'R' AND l_linestatus = 'F'"), C),
    "where_or": ("order_tree", "with @root.status as @s where @s = 'F' or @s = 'P' select @s", _sql(ORDER, STATUS_V, where="r.o_orderstatus IN ('F', 'P')"), C),
    "where_or_lifted": ("order_tree", "with @root > lineitem as @l where @l.flag = 'R' or @l.linestatus = 'O' select @l.qty", _sql(ORDER, QTY_V, LINE, where="l_returnflag = 'R' OR l_linestatus = 'O'"), C),
    "where_not": ("order_tree", "with @root.status as @s where not @s = 'F' select @s", _sql(ORDER, STATUS_V, where="r.o_orderstatus <> 'F'"), C),
    "where_not_grouped": ("order_tree", "with @root.status as @s, @root.priority as @p where not (@s = 'F' or @p ~ /URGENT/) select {p: @p, s: @s}", _sql(ORDER, _record(p=PRIORITY_V, s=STATUS_V), where="NOT (r.o_orderstatus = 'F' OR regexp_matches(r.o_orderpriority, 'URGENT'))"), C),
    "any_quantifier": ("order_tree", "with @root.status as @s where any @l in @root > lineitem: @l.flag = 'R' select @s", _sql(ORDER, STATUS_V, where=_with_line("l_returnflag = 'R'")), C),
    "all_quantifier": ("order_tree", "with @root.status as @s where all @l in @root > lineitem: @l.flag = 'R' select @s", _sql(ORDER, STATUS_V, where="NOT " + _with_line("l_returnflag <> 'R'")), C),
    "all_vacuous": ("order_tree", "with order as @o where all @l in @o > lineitem: @l.flag = 'none' select @o.status", _sql(ORDER, STATUS_V, where="NOT " + _with_line()), C),
    "not_any": ("order_tree", "with @root.status as @s where not any @l in @root > lineitem: @l.flag = 'R' select @s", _sql(ORDER, STATUS_V, where="NOT " + _with_line("l_returnflag = 'R'")), C),
    "not_all": ("order_tree", "with @root.status as @s where not all @l in @root > lineitem: @l.flag = 'R' select @s", _sql(ORDER, STATUS_V, where=_with_line("l_returnflag <> 'R'")), C),
    "nested_any": ("order_tree", "with @root.priority as @p where any @a in @root > lineitem: any @b in @a.flag: @b = 'N' select @p", _sql(ORDER, PRIORITY_V, where=_with_line("l_returnflag = 'N'")), C),
    "nested_any_correlated": ("order_tree", "with @root > lineitem as @l where @l != null and any @m in @root > lineitem: any @q in @m.qty: @m = @l and @q = '50' select @l.flag", _sql(ORDER, FLAG_V, LINE, where="l_quantity = 50"), C),
    "any_descendant_source": ("order_tree", "with @root.status as @s where any @q in @root >> quantity: @q = '50' select @s", _sql(ORDER, STATUS_V, where=_with_line("l_quantity = 50")), C),
    "any_or_inside": ("order_tree", "with @root.status as @s where any @q in @root >> quantity: @q = '50' or @q = '49' select @s", _sql(ORDER, STATUS_V, where=_with_line("l_quantity IN (49, 50)")), C),
    "where_nav_fanout_duplicates": ("order_tree", "with @root.status as @s where (@root >> quantity) != null select @s", _sql(ORDER, STATUS_V, LINE), C),
    "or_branch_death": ("order_tree", "with @root.status as @s where @root > lineitem = 'x' or @s = 'F' select @s", _sql(ORDER, STATUS_V, LINE, where="r.o_orderstatus = 'F'"), C),
    "forced_in_probe_reads_nothing": ("order_tree", "with @root.status as @s where any @l in @root > lineitem: @l.flag = 'R' or @s = 'F' select @s", _sql(ORDER, "'null'", where=_with_line("l_returnflag = 'R'") + " OR r.o_orderstatus = 'F' AND " + _with_line()), C),
    "any_or_branch_death": ("order_tree", "with @root.status as @s where @s != null and any @l in @root > lineitem: @l.flag = 'R' or @s = 'F' select @s", _sql(ORDER, STATUS_V, where=_with_line("l_returnflag = 'R'") + " OR r.o_orderstatus = 'F' AND " + _with_line()), C),
    "not_any_denotational": ("order_tree", "with @root.status as @s where not (any @l in @root > lineitem: @l.flag = 'R') select @s", _sql(ORDER, STATUS_V, where="NOT " + _with_line("l_returnflag = 'R'")), D),
    "select_literal": ("order_tree", "with @root.status as @s where @s = 'P' select 'open'", _sql(ORDER, "'open'", where="r.o_orderstatus = 'P'"), C),
    "select_number": ("order_tree", "with @root > lineitem as @l where @l.flag = 'N' select 7", _sql(ORDER, "'7'", LINE, where="l_returnflag = 'N'"), C),
    "select_null": ("order_tree", "with order as @o select null", _sql(ORDER, "'null'"), C),
    "select_record": ("order_tree", "with @root > lineitem as @l select {of: @root.status, qty: @l.qty}", _sql(ORDER, _record(of=STATUS_V, qty=QTY_V), LINE), C),
    "select_record_shorthand": ("order_tree", "with @root.status as @s, @root.priority as @p select {@s, @p}", _sql(ORDER, _record(p=PRIORITY_V, s=STATUS_V)), C),
    "select_list": ("order_tree", "with @root.status as @s select [@s, @root.priority]", _sql(ORDER, f"'(' || {STATUS_V} || '|' || {PRIORITY_V} || ')'"), C),
    "select_tuple": ("order_tree", "with @root > lineitem as @l select ('line', 1, @l.flag)", _sql(ORDER, f"'(line|1|' || {FLAG_V} || ')'", LINE), C),
    "select_nested_constructor": ("order_tree", "with @root > lineitem as @l select {head: [@root.status, null], tail: {qty: @l.qty}}", _sql(ORDER, _record(head=f"'(' || {STATUS_V} || '|null)'", tail=_record(qty=QTY_V)), LINE), C),
    "select_navigation": ("conv_tree", "select @root > turn", _sql(TURN, _v("turn")), C),
    "subquery_select_list": ("order_tree", "select (select @root > lineitem.qty)", _sql(ORDER, ALL_QTY_V, ALL_QTY), C),
    "subquery_correlated_list": ("geo_tree", "with @root > nation as @n select {name: @n.name, segments: (select @n > customer.segment)}", _sql(REGION, _record(name=NATION_V, segments="'[' || coalesce(s.xs, '') || ']'"), NATION, _listed("s", "c_nationkey", SEGMENT_V, "c_custkey", "customer") + " = n.n_nationkey"), C),
    "subquery_binding_list": ("order_tree", "with @root.status as @s, select @root > lineitem.qty as @all select {s: @s, all: @all}", _sql(ORDER, _record(all=ALL_QTY_V, s=STATUS_V), ALL_QTY), C),
    "subquery_with_where": ("order_tree", "with @root.status as @s select {s: @s, r: (with @root > lineitem as @l where @l.flag = 'R' select @l.qty)}", _sql(ORDER, _record(r=RETURNED_V, s=STATUS_V), RETURNED), C),
    "subquery_empty": ("order_tree", "with @root.status as @s select {s: @s, none: (select @root > nothing_here)}", _sql(ORDER, _record(none="'[]'", s=STATUS_V)), C),
    "subquery_forced_inside": ("order_tree", "with @root > lineitem as @l select (select @l.qty)", _sql(ORDER, ALL_QTY_V, ALL_QTY), C),
    "nested_subquery": ("geo_tree", "with @root.name as @n select {n: @n, nations: (with @root > nation as @x where @x.name ~ /^[A-C]/ select {name: @x.name, firsts: (with @x > customer as @c where @c.segment = 'BUILDING' select @c.name)})}", _sql(REGION, _record(n=REGION_V, nations="'[' || coalesce(x.xs, '') || ']'"), _listed("x", "n_regionkey", _record(firsts="'[' || coalesce(f.xs, '') || ']'", name=NATION_V), "n_nationkey", "nation " + _listed("f", "c_nationkey", CUSTOMER_V, "c_custkey", "customer", "c_mktsegment = 'BUILDING'") + " = n_nationkey", "regexp_matches(n_name, '^[A-C]')") + " = r.r_regionkey"), C),
    "unnest_fanout": ("order_tree", "with @root.status as @s, unnest(select @root > lineitem.qty) as @q select {s: @s, q: @q}", _sql(ORDER, _record(q=QTY_V, s=STATUS_V), LINE), C),
    "unnest_empty_drops": ("order_tree", "with @root.status as @s, unnest(select @root > nothing_here) as @q select {s: @s, q: @q}", _sql(ORDER, STATUS_V, where="FALSE"), C),
    "scope_shadowing": ("order_tree", "with @root.status as @x, unnest(with @root.priority as @x select @x) as @inner select {inner: @inner, outer: @x}", _sql(ORDER, _record(inner=PRIORITY_V, outer=STATUS_V)), C),
    "optional_compat": ("order_tree", "with @root.nothing as @x? where @x = null select @root.status", _sql(ORDER, STATUS_V, where="FALSE"), C),
    "optional_denotational": ("order_tree", "with @root > lineitem as @l? where @l = null select @root.status", _sql(ORDER, STATUS_V, where="NOT " + _with_line()), D),
    "numeric_lt_gt": ("order_tree", "with @root.status as @s where 1 < 2 and 3 > 2 select @s", _sql(ORDER, STATUS_V), C),
    "numeric_text_denotational": ("order_tree", "with @root >> quantity as @q where @q >= 49 select @q", _sql(ORDER, QTY_V, LINE, where="l_quantity >= 49"), D),
    "named_query_denotational": ("order_tree", "query lines(@x: order): Array<lineitem> { select @root > lineitem } with lines() as @l select @l.qty", _sql(ORDER, QTY_V, LINE), D),
    "named_query_compat": ("order_tree", "query flags { with @root > lineitem as @l select @l.flag }", _sql(ORDER, FLAG_V, LINE), C),
    "conversation_roles": ("conv_tree", "with @root > turn as @t where @t.role = 'user' select @t.content", _sql(TURN, _v("content", "t.text"), where="t.role = 'user'"), C),
    "user_events": ("user_tree", "with @root > event as @e where @e.type ~ /^(click|purchase)$/ select @e.type", _sql(EVENT, _v("event_type", "e.event_type"), where="regexp_matches(e.event_type, '^(click|purchase)$')"), C),
    "document_lines": ("doc_tree", "with @root > line as @l, @root.lang as @g where @g = 'en' and @l ~ /of the/ select @l", _sql("x.doc_id of (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) x", _v("line", "x.line"), where="x.lang = 'en' AND regexp_matches(x.line, 'of the')"), C),
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, text, _, semantics = QUERIES[name]
    return TreeEngine(spark, semantics).compile(text).run_text(getattr(trees, tree)(spark, sf_dir))


def _json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TreeEngine(spark).compile("with @root > turn as @t where @t.role = 'user' select @t.role").envelope(trees.conv_tree(spark, sf_dir))


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TreeEngine(spark).compile("with @root >> a as @a select {href: @a.href, text: @a > text}").run_text(parse.page_tree(spark, sf_dir))


def _node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six fields of node results as columns."""
    rows = TreeEngine(spark).compile("with @root > turn as @t select @t.role").run(trees.conv_tree(spark, sf_dir))
    return rows.select("doc_id", *[F.col(f"value.{c}") for c in ("kind", "text", "start_byte", "end_byte")], F.col("value.start_point.row").alias("start_row"), F.col("value.end_point.column").alias("end_column"))


OTHERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"json_sink": _json_sink, "page_tree_links": _page_links, "node_result_fields": _node_values}
_POINT = '{"row":0,"column":0}'
_LINK = r'''<a href="([^"]*)">([^<]*\S[^<]*)</a>'''
_OTHER_SQL = {
    # links of these pages have one attribute and one text, and stand in no comment or script
    "page_tree_links": f"""SELECT CAST(page_id AS BIGINT) AS doc_id, '{{href=attribute_value:' || regexp_extract(x, '{_LINK}', 1) || ';text=text:' || regexp_extract(x, '{_LINK}', 2) || '}}' AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}')) AS x FROM pages) p""",
    "json_sink": f"""SELECT CAST(conv_id AS BIGINT) AS doc_id, '{{"file":"' || conv_id || '","values":[' || string_agg('{{"kind":"role","text":"user","start_byte":0,"end_byte":0,"start_point":{_POINT},"end_point":{_POINT}}}', ',') || ']}}' AS json FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "node_result_fields": "SELECT CAST(conv_id AS BIGINT) AS doc_id, 'role' AS kind, role AS text, 0 AS start_byte, 0 AS end_byte, 0 AS start_row, 0 AS end_column FROM conversations",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, name) for name in QUERIES} | OTHERS


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql, _) in QUERIES.items()} | _OTHER_SQL
