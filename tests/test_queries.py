"""Queries over hand-written trees of classes and functions, in both semantics."""

import json

import pytest

from canopy import sink
from canopy.engine import TreeEngine, limited
from canopy.errors import InvalidArgumentsError, InvalidUnnestArgumentError, InvalidVariableReferenceError, QueryError, UnexpectedTypeError, UnsupportedQueryError
from canopy.sources.fixture import fixture
from canopy.sources.parse import in_memory


def method(name, body="{}"):
    return f'(method_definition "{name}() {body}" name:(property_identifier "{name}") parameters:(formal_parameters "()") body:(statement_block "{body}"' + (' (return_statement "return 1;")' if "return" in body else "") + "))"


def klass(name, *methods):
    inner = " ".join(f"{m}() {{}};" for m in methods)
    text = f"class {name} {{ {inner} }}" if methods else f"class {name} {{}}"
    body = "{ " + inner + " }" if methods else "{}"
    return text, f'(class_declaration "{text}" name:(type_identifier "{name}") body:(class_body "{body}" ' + " ".join(map(method, methods)) + "))"


def program(*parts):
    return "\n".join(t for t, _ in parts), "(program " + " ".join(s for _, s in parts) + ")"


def function(name, result=None):
    text = f"function {name}(){': ' + result if result else ''} {{ return; }}"
    kind = f'return_type:(type_annotation ": {result}") ' if result else ""
    return text, f'(function_declaration "{text}" name:(identifier "{name}") {kind}body:(statement_block "{{ return; }}"))'


def c_function(result, name, *params):
    text = f"{result} {name}({', '.join(params) if params else 'void'}) {{ return 0; }}"
    given = "".join(f'(parameter_declaration "{p}" type:(primitive_type "{p.split()[0]}") declarator:(identifier "{p.split()[1]}"))' for p in params) or '(parameter_declaration "void" type:(primitive_type "void"))'
    inside = f"({', '.join(params) if params else 'void'})"
    return text, f'(function_definition "{text}" type:(primitive_type "{result}") declarator:(function_declarator "{name}{inside}" declarator:(identifier "{name}") parameters:(parameter_list "{inside}" {given})) body:(compound_statement "{{ return 0; }}"))'


CODE = {
    "classes": program(klass("Service"), klass("Controller"), klass("Repository")),
    "methods": program(klass("Service", "foo", "bar"), klass("Controller", "foo", "bar")),
    "all": program(klass("A", "foo", "foo"), klass("B", "foo", "bar")),
    "three": program(klass("Service", "foo"), klass("Service", "bar"), klass("Other", "foo")),
    "functions": program(function("a", "number"), function("b"), function("c", "string")),
    "c": program(c_function("int", "add", "int a", "int b"), c_function("int", "twice", "int n")),
    "mixed": program(c_function("int", "f", "int a", "char b", "int c"), c_function("int", "main")),
}
ORDER = list(CODE)


@pytest.fixture(scope="module")
def run(spark):
    made = {}

    def go(code, text, semantics="compat"):
        if code not in made:
            source, tree = CODE[code]
            made[code] = fixture(spark, {0: (source, tree.replace("(program", "(translation_unit", 1) if code in ("c", "mixed") else tree)}).cache()
        rows = TreeEngine(spark, semantics).compile(text).run_json(made[code]).orderBy("doc_id", "__ord").collect()
        return [brief(json.loads(r.value)) for r in rows]

    return go


def brief(v):
    if isinstance(v, dict) and v.keys() == {"kind", "text", "start_byte", "end_byte", "start_point", "end_point"}:
        return v["text"]
    if isinstance(v, dict):
        return {k: brief(x) for k, x in v.items()}
    return [brief(x) for x in v] if isinstance(v, list) else v


S, K, REP = "class Service {}", "class Controller {}", "class Repository {}"
METHODS = "any @m in @c.body > method_definition: "
DECL = "with @root > function_definition.declarator as @d"

CASES = [
    # navigation
    ("classes", "with @root > class_declaration as @c select @c", [S, K, REP]),
    ("classes", "with @root > class_declaration.name as @n select @n", ["Service", "Controller", "Repository"]),
    ("methods", "with @root > class_declaration > class_body as @b, @b > method_definition as @m select @m", ["foo() {}", "bar() {}"] * 2),
    ("methods", "with (@root > class_declaration) >> property_identifier as @i select @i", ["foo", "bar"] * 2),
    ("methods", "with @root > class_declaration as @c, (@c > class_body) > method_definition as @m select @m.name", ["foo", "bar"] * 2),
    ("methods", "class_declaration as @c select @c".join(["with ", ""]), []),
    ("methods", "with program as @p select @p > class_declaration.name", ["Service", "Controller"]),
    # projections
    ("classes", "with @root > class_declaration as @c select [@c.name]", [["Service"], ["Controller"], ["Repository"]]),
    ("classes", "with @root > class_declaration as @c, @c.name as @n select ('class', @n, null, 7)", [["class", n, None, 7] for n in ("Service", "Controller", "Repository")]),
    ("classes", "with @root > class_declaration as @c, @c.name as @n select {@n, kind: 'it\"s', deep: {b: [1, @n], a: 2}}", [{"n": n, "kind": 'it"s', "deep": {"a": 2, "b": [1, n]}} for n in ("Service", "Controller", "Repository")]),
    # predicates
    ("classes", "with @root > class_declaration as @c where @c.name = 'Service' select @c", [S]),
    ("classes", "with @root > class_declaration as @c where @c.name != 'Service' select @c", [S]),
    ("classes", "with @root > class_declaration as @c, @c.name as @n where @n = 'Service' or @n = 'Controller' select @c", [S, K]),
    ("classes", "with @root > class_declaration as @c where @c.name = 'Service' or @c.name = 'Controller' select @c", [S, K]),
    ("classes", "with @root > class_declaration as @c, @c.name as @n where @n ~ /^Ser/ select @c", [S]),
    ("classes", "with @root > class_declaration as @c, @c.name as @n where @n !~ /er/ select @c", [REP]),
    ("methods", f"with @root > class_declaration as @c where {METHODS}@m.name = 'none' select @c", []),
    ("methods", f"with @root > class_declaration as @c where @c.name = 'Service' and {METHODS}@m.name = 'bar' select @c.name", ["Service"]),
    ("all", "with @root > class_declaration as @c where all @m in @c.body > method_definition: @m.name = 'foo' select @c.name", ["A"]),
    ("all", "with @root > class_declaration as @c where not all @m in @c.body > method_definition: @m.name = 'foo' select @c.name", ["B"]),
    ("all", f"with @root > class_declaration as @c where not {METHODS}@m.name = 'bar' select @c.name", ["A"]),
    ("classes", "with @root > class_declaration as @c where all @m in @c.body > method_definition: @m.name = 'x' select @c.name", ["Service", "Controller", "Repository"]),
    ("three", f"with @root > class_declaration as @c where @c.name = 'Service' and {METHODS}@m.name = 'foo' select @c", ["class Service { foo() {}; }"]),
    ("three", "with @root > class_declaration as @c where any @a in @c.body > method_definition: any @b in @c.body > method_definition: @a.name = @b.name select @c.name", ["Service", "Service", "Other"]),
    ("three", "with @root > class_declaration as @c where any @m in @c >> method_definition: @m.name = 'bar' select @c.name", ["Service"]),
    ("three", f"with @root > class_declaration as @c where {METHODS}@m.name = 'foo' or @m.name = 'bar' select @c.name", ["Service", "Service", "Other"]),
    ("three", f"with @root > class_declaration as @c where {METHODS}(@m.body > return_statement) != null select @c.name", []),
    ("functions", "with @root > function_declaration as @f, @f.return_type as @r? where @r = null select @f.name", []),
    ("functions", "with @root > function_declaration as @f, @f.return_type as @r? where @r != null select @f.name", ["a", "c"]),
    ("functions", "with @root > function_declaration as @f where @f.return_type is null select @f.name", ["b"]),
    ("functions", "with @root > function_declaration as @f where @f.return_type is not null select @f.name", ["a", "c"]),
    ("functions", "with @root > function_declaration as @f where not (@f.return_type is null) select @f.name", []),
    ("functions", "with @root > function_declaration as @f, @root > function_declaration as @g where @f = @g select @g.name", ["a", "b", "c"]),
    ("functions", "with @root > function_declaration as @f where 1 < 2 and 2 > 1 and 3 = 3 select @f.name", ["a", "b", "c"]),
    # subqueries
    ("c", "with @root > function_definition as @f select (select @f.declarator.parameters > parameter_declaration)", [["int a", "int b", "int n"]]),
    ("c", "with @root > function_definition as @f select (select @f > goto_statement)", [[]]),
    ("c", "with @root > function_definition as @f select {fn: @f.type, n: (select @root > function_definition.type)}", [{"fn": "int", "n": ["int", "int"]}] * 2),
    ("c", f"{DECL} select {{name: @d.declarator, params: select @d.parameters > parameter_declaration}}", [{"name": "add", "params": ["int a", "int b"]}, {"name": "twice", "params": ["int n"]}]),
    ("c", f"{DECL}, select @d.parameters > parameter_declaration as @p, @d.declarator as @n select {{name: @n, param: @p}}", [{"name": "add", "param": ["int a", "int b"]}, {"name": "twice", "param": ["int n"]}]),
    ("c", f"{DECL}, @d.parameters > parameter_declaration as @p, @d.declarator as @n select {{name: @n, param: @p}}", [{"name": "add", "param": "int a"}, {"name": "add", "param": "int b"}, {"name": "twice", "param": "int n"}]),
    ("c", f"{DECL}, unnest(select @d.parameters > parameter_declaration) as @p, @d.declarator as @n select {{name: @n, param: @p}}", [{"name": "add", "param": "int a"}, {"name": "add", "param": "int b"}, {"name": "twice", "param": "int n"}]),
    ("c", "with @root > function_definition as @f, unnest(select @f > goto_statement) as @g select {fn: @f, g: @g}", []),
    ("c", "with @root > function_definition as @x, unnest(with @root > function_definition.declarator as @x select @x) as @inner where @x.type = 'int' select {inner: @inner, outer: @x.type}", [{"inner": d, "outer": "int"} for d in ("add(int a, int b)", "twice(int n)")] * 2),
    ("mixed", "with @root > function_definition as @f select {fn: @f.type, ints: (with @f.declarator.parameters > parameter_declaration as @p, @p.type as @t where @t = 'int' select @p)}", [{"fn": "int", "ints": ["int a", "int c"]}, {"fn": "int", "ints": []}]),
    ("mixed", "with @root > function_definition as @f select {fn: @f.type, deep: (with @f.declarator as @d select (select @d.parameters > parameter_declaration))}", [{"fn": "int", "deep": [["int a", "char b", "int c"]]}, {"fn": "int", "deep": [["void"]]}]),
]


@pytest.mark.parametrize(("code", "text", "want"), CASES)
def test_compat(run, code, text, want):
    assert run(code, text) == want


DENOTATIONAL = [
    ("classes", "with @root > class_declaration as @c where @c.name != 'Service' select @c", [K, REP]),
    ("functions", "with @root > function_declaration as @f, @f.return_type as @r? where @r = null select @f.name", ["b"]),
    ("functions", "with @root > function_declaration as @f, @f.return_type as @r? select {f: @f.name, r: @r}", [{"f": "a", "r": ": number"}, {"f": "b", "r": None}, {"f": "c", "r": ": string"}]),
    ("functions", "with @root > function_declaration as @f where not (@f.return_type is null) select @f.name", ["a", "c"]),
    ("functions", "with @root > function_declaration as @f, @root > function_declaration as @g select @f.name", ["a"] * 3 + ["b"] * 3 + ["c"] * 3),
    ("functions", "with @root > function_declaration as @f where 2 >= 2 and 1 <= 2 select @f.name", ["a", "b", "c"]),
    ("methods", f"with @root > class_declaration as @c where {METHODS}@m.name = 'x' or @c.name = 'Service' select @c.name", ["Service"]),
    ("classes", f"with @root > class_declaration as @c where {METHODS}@m.name = 'x' or @c.name = 'Service' select @c.name", []),
    ("methods", f"with @root > class_declaration as @c where ({METHODS}@m.name = 'x') or @c.name = 'Service' select @c.name", ["Service"]),
    ("c", "query fs { with @root > function_definition as @f select @f } with fs() as @f select @f.type", ["int", "int"]),
]


@pytest.mark.parametrize(("code", "text", "want"), DENOTATIONAL)
def test_denotational(run, code, text, want):
    assert run(code, text, "denotational") == want


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("select @nowhere", InvalidVariableReferenceError),
        ("with @root > a as @a where @a >= 1 select @a", UnsupportedQueryError),
        ("with @root > a as @a where @a > 1 select @a", InvalidArgumentsError),
        ("with @root > a as @a where @a = /x/ select @a", UnsupportedQueryError),
        ("with @root > a as @a where @a ~ @root select @a", InvalidArgumentsError),
        ("with @root > a as @a where 'x' = 'x' select @a", UnsupportedQueryError),
        ("with other(@root) as @a select @a", InvalidUnnestArgumentError),
        ("with unnest(@root) as @a select @a", InvalidUnnestArgumentError),
        ("#import 'x'", UnsupportedQueryError),
        ("select f()", UnsupportedQueryError),
        ("with select @root as @l select @l > a", UnexpectedTypeError),
        ("with @root > a as @a where any @m in @a > b: @m = 'x' select @m", InvalidVariableReferenceError),
        (r"with @root > a as @a where @a ~ /\Kx/ select @a", UnsupportedQueryError),
    ],
)
def test_refused(run, text, error):
    with pytest.raises(error):
        run("classes", text)
    assert issubclass(error, QueryError)


def test_only_the_first_query_runs(run):
    assert run("classes", "select @root > class_declaration.name select 1") == ["Service", "Controller", "Repository"]


def test_result_nodes_and_sinks(spark):
    nodes = fixture(spark, {3: CODE["c"], 4: CODE["classes"]})
    query = TreeEngine(spark).compile("select @root > function_definition.declarator.declarator")
    got = json.loads(sink.document(query, nodes))
    first = {"kind": "identifier", "text": "add", "start_byte": 4, "end_byte": 7, "start_point": {"row": 0, "column": 4}, "end_point": {"row": 0, "column": 7}}
    assert [r["file"] for r in got["results"]] == ["3"] and got["results"][0]["values"][0] == first
    assert got["stats"].keys() == {"read_time_ns", "parse_time_ns", "query_time_ns"}
    assert json.loads(sink.values(query, nodes))["values"][0] == first
    assert [r.value.text for r in limited(query, nodes, 1).collect()] == ["add"]
    assert "MapInPandas" not in query.explain(nodes)


def test_python_and_pages(spark):
    code = "def add(a, b):\n    return a + b\n\nclass Ä:\n    def run(self):\n        return add(1, 2)\n"
    query = TreeEngine(spark).compile("with @root >> FunctionDef as @f select @f.name")
    assert [r.value.text for r in query.run(in_memory(spark, code, "python")).orderBy("__ord").collect()] == ["add", "run"]
    page = "<html><body><p><b>One<br><p>Two <a href='/x'>link</a><script>var a='</p>'</script></body></html>"
    links = TreeEngine(spark).compile("with @root >> a as @a select {href: @a.href, text: @a > text}")
    assert [json.loads(r.value)["href"]["text"] for r in links.run_json(in_memory(spark, page, "html")).collect()] == ["/x"]
    broken = in_memory(spark, "def (", "python").collect()
    assert [r.kind for r in broken] == ["ERROR"]


def test_file_scan_stream_and_command_line(spark, tmp_path, capsys):
    from canopy.__main__ import main
    from canopy.sources.parse import source_tree
    from canopy.streaming import run_stream

    (tmp_path / "code/deep").mkdir(parents=True)
    (tmp_path / "code/a.py").write_text("def one(): pass\n")
    (tmp_path / "code/deep/b.py").write_text("def two(): pass\n")
    (tmp_path / "code/c.txt").write_text("def three(): pass\n")
    query = TreeEngine(spark).compile("select @root >> FunctionDef.name")
    rows = query.run(source_tree(spark, str(tmp_path / "code"), "python")).collect()
    assert sorted(r.value.text for r in rows) == ["one", "two"]
    spark.createDataFrame([(1, "def s(): pass")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = run_stream(spark, str(tmp_path / "in"), "doc_id long, text string", query, lambda df, n: got.extend(r.value for r in df.collect()), str(tmp_path / "ck"), "python")
    stream.awaitTermination(60)
    assert [json.loads(x)["text"] for x in got] == ["s"]
    assert main(["-l", "python", "select @root >> FunctionDef.name", str(tmp_path / "code")]) == 0
    assert len(json.loads(capsys.readouterr().out)["results"]) == 2
    assert main(["-l", "none", "x", "y"]) == 5


C_TEXT = "int add(int a) {\n  return a;\n}\n/* ä */ int b;\n"
C_TREE = """(translation_unit [0, 0] - [4, 0]
  (function_definition [0, 0] - [2, 1]
    type: (primitive_type [0, 0] - [0, 3])
    declarator: (function_declarator [0, 4] - [0, 14]
      declarator: (identifier [0, 4] - [0, 7])
      parameters: (parameter_list [0, 7] - [0, 14]))
    body: (compound_statement [0, 15] - [2, 1]
      (return_statement [1, 2] - [1, 11]
        (identifier [1, 9] - [1, 10]))))
  (comment [3, 0] - [3, 8])
  (declaration [3, 9] - [3, 15]
    type: (primitive_type [3, 9] - [3, 12])
    declarator: (identifier [3, 13] - [3, 14])))
"""


def test_printed_trees(spark):
    from canopy.sources.exported import exported, tree_nodes

    found = {(n[3], n[6]) for n in tree_nodes(C_TEXT, C_TREE)}
    assert {("identifier", "add"), ("identifier", "a"), ("comment", "/* ä */"), ("identifier", "b"), ("translation_unit", C_TEXT)} <= found
    rows = spark.createDataFrame([(1, C_TEXT, C_TREE), (2, C_TEXT, None), (3, None, "")], "doc_id long, text string, tree string")
    names = TreeEngine(spark).compile("select @root > function_definition.declarator.declarator").run_json(exported(rows)).collect()
    assert [(r.doc_id, json.loads(r.value)) for r in names] == [(1, {"kind": "identifier", "text": "add", "start_byte": 4, "end_byte": 7, "start_point": {"row": 0, "column": 4}, "end_point": {"row": 0, "column": 7}})]
    for broken in ("(a [0, 0] - [0, 1]", "(a [0, 0] - [0, 1]))", "(a [9, 0] - [9, 1])", "(a)"):
        with pytest.raises(ValueError):
            tree_nodes("x", broken)


def test_command_line_with_printed_trees(spark, tmp_path, capsys):
    from canopy.__main__ import main

    (tmp_path / "f.c").write_text(C_TEXT)
    query = "select @root > function_definition.declarator.declarator"
    assert main(["-l", "c", query, str(tmp_path)]) == 4
    assert "1 files have no .tree" in capsys.readouterr().err
    (tmp_path / "f.c.tree").write_text(C_TREE)
    for path in (tmp_path, tmp_path / "f.c"):
        assert main(["-l", "c", query, str(path)]) == 0
        out = json.loads(capsys.readouterr().out)
        assert [[v["text"] for v in r["values"]] for r in out["results"]] == [["add"]]
        assert out["stats"]["read_time_ns"] > 0
    assert main(["-s", "denotational", "#language 'c'\n" + query, str(tmp_path)]) == 0
    assert main([query, str(tmp_path)]) == 4


def test_plans_of_probes_do_not_double(spark):
    """Scans of nodes in the plan of several probes; powers of two would give 62 for four."""
    from canopy.engine import TreeEngine
    from canopy.sources import trees

    nodes = trees.order_tree(spark, "/root/testdata/sf0.001")

    def scans(text):
        return TreeEngine(spark).compile(text).run_text(nodes)._jdf.queryExecution().optimizedPlan().toString().count("Relation [o_orderkey")

    term = "any @{0} in @root > lineitem: @{0}.flag = 'R'"
    many = [scans("with @root.status as @s where " + " and ".join(term.format(v) for v in "abcd"[:n]) + " select @s") for n in (4,)]
    lists = [scans("with @root.status as @s select {s: @s, " + ", ".join(f"{v}: (select @root > lineitem.qty)" for v in "abcd"[:n]) + "}") for n in (4,)]
    for found in (many, lists):
        assert found[-1] <= 32, found
