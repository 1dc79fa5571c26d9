"""The query language: shapes, precedence, literals, errors."""

import pytest

from canopy.errors import QuerySyntaxError
from canopy.plans.syntax import parse, to_sexpr


def shape(text):
    return to_sexpr(parse(text)).removeprefix("(source_file ").removesuffix(")")


def where(predicate):
    return shape(f"where {predicate} select @x").removeprefix("(query_body (where ").removesuffix(") (select x))")


def select(expression):
    return shape(f"select {expression}").removeprefix("(query_body (select ").removesuffix("))")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@a.b", "(field a b)"),
        ("@a > b.c", "(field (child a (node b)) c)"),
        ("@a > b > c", "(child (child a (node b)) (node c))"),
        ("@a >> b > c", "(descendant a (child (node b) (node c)))"),
        ("@a > b >> c", "(descendant (child a (node b)) (node c))"),
        ("@a descendant::b", "(descendant a (node b))"),
        ("(@a > b).c", "(field (paren (child a (node b))) c)"),
        ("@a.where", "(field a where)"),
        ("'it'", '(string "it")'),
        (r"'a\'b'", r'(string "a\'b")'),
        ("12", "(number 12)"),
        ("null", "null"),
        ("f()", "(call f)"),
        ("f(@a, 'b')", '(call f a (string "b"))'),
        ("{ @a, k: @b.c }", "(object a (k (field b c)))"),
        ("{}", "(object)"),
        ("[]", "(array)"),
        ("[@a, 1]", "(array a (number 1))"),
        ("(@a, 'b', 3)", '(tuple a (string "b") (number 3))'),
        ("(select @a)", "(paren (subquery (query_body (select a))))"),
        ("{ k: with @a > b as @c where @c = 'x' select @c }", '(object (k (subquery (query_body (with (binding (child a (node b)) c)) (where (eq c (string "x"))) (select c)))))'),
    ],
)
def test_expressions(text, want):
    assert select(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@a = 'x'", '(eq a (string "x"))'),
        ("@a != @b", "(ne a b)"),
        (r"@a ~ /x\/y+/", r'(regex_match a (regex "x\/y+"))'),
        ("@a !~ /x/", '(regex_not_match a (regex "x"))'),
        ("@a > 5", "(gt a (number 5))"),
        ("@a >= 5 and @b <= 3", "(and (ge a (number 5)) (le b (number 3)))"),
        ("@a > b = 'x'", '(eq (child a (node b)) (string "x"))'),
        ("@a is null", "(is-null a)"),
        ("@a.b is not null", "(is-not-null (field a b))"),
        ("@a = 1 or @b = 2 and @c = 3", "(or (eq a (number 1)) (and (eq b (number 2)) (eq c (number 3))))"),
        ("not @a = 1 and @b = 2", "(and (not (eq a (number 1))) (eq b (number 2)))"),
        ("(@a = 1 or @b = 2) and @c = 3", "(and (paren (or (eq a (number 1)) (eq b (number 2)))) (eq c (number 3)))"),
        ("(@a.b > c) != null", "(ne (paren (child (field a b) (node c))) null)"),
        ("any @m in @a > b: @m = 'x' and @a = 'y'", '(any m (child a (node b)) (and (eq m (string "x")) (eq a (string "y"))))'),
        ("@a = 'y' and all @m in @a > b: any @n in @m.c: @n = @m", '(and (eq a (string "y")) (all m (child a (node b)) (any n (field m c) (eq n m))))'),
        ("not any @m in @a > b: @m = 'x'", '(not (any m (child a (node b)) (eq m (string "x"))))'),
    ],
)
def test_predicates(text, want):
    assert where(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("#language 'c'\nselect @a", '(language "c") (query_body (select a))'),
        ("#import 'x.query'", '(import "x.query")'),
        ("-- note\nselect @a -- end", "(query_body (select a))"),
        ("with @root > a as @x?, @x as @y select @y", "(query_body (with (binding (child root (node a)) x optional) (binding x y)) (select y))"),
        ("query q { select @a }", "(query q (parameters) (query_body (select a)))"),
        ("query q(@a: node, @b): Array<string?> { select @a }", "(query q (parameters (param a node) (param b)) (return_type (array_type (optional string))) (query_body (select a)))"),
        ("query q: Tuple<Object<number>, Array<Array<regex>>> { select @a }", "(query q (parameters) (return_type (tuple_type (object_type number) (array_type (array_type regex)))) (query_body (select a)))"),
        ("select @a select @b", "(query_body (select a)) (query_body (select b))"),
    ],
)
def test_files(text, want):
    assert shape(text) == want


@pytest.mark.parametrize("text", ["", "with @a", "select", "select @a where", "where @a select @a", "select 'x", "query { select @a }", "select (@a", "#other 'x'"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)
