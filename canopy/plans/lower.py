"""From a syntax tree to DataFrame joins.

`compat` demands bindings at their first use, in the order of where and select, and lets a row die
where a navigation reaches nothing; `denotational` binds eagerly in the order of `with`, keeps
optional bindings by outer joins and reads predicates as plain booleans. Names and what they are
bound to live in the planner; rows only have the nodes' columns, which Catalyst prunes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.errors import InvalidArgumentsError, InvalidUnnestArgumentError, InvalidVariableReferenceError, UnexpectedTypeError, UnsupportedQueryError
from canopy.functions.values import NODE, Value, checked_regex, materialised
from canopy.operators import navigation
from canopy.plans import syntax as s

COMPAT, DENOTATIONAL = "compat", "denotational"
NOTHING = Value("nothing")


@dataclass(frozen=True)
class State:
    """Live rows: their DataFrame, what each variable is, and the node that the cursor stands on.

    After a probe, wide has the rows without what probes have taken away. The next probe starts from
    there: it asks about more values than are live, but n probes make a plan of some n^2 scans, not 2^n.
    """

    rows: DataFrame
    env: dict
    cursor: str
    wide: DataFrame | None = None

    def probed(self, rows: DataFrame) -> State:
        return replace(self, rows=rows, wide=self.rows if self.wide is None else self.wide)

    def bound(self, var: int, value: Value) -> State:
        return replace(self, env={**self.env, var: value})


@dataclass
class Scope:
    names: dict[str, int] = field(default_factory=dict)


class Planner:
    def __init__(self, nodes: DataFrame, semantics: str = COMPAT, queries: dict | None = None) -> None:
        if semantics not in (COMPAT, DENOTATIONAL):
            raise ValueError(semantics)
        self.nodes, self.compat = nodes, semantics == COMPAT
        self.queries = queries or {}
        self.scopes = [Scope({"root": 0})]
        self.bindings: dict[int, object] = {}
        self.emitted = {0}
        self.fresh_number = 0

    # -- names --

    def fresh(self, stem: str = "n") -> str:
        self.fresh_number += 1
        return f"{stem}{self.fresh_number}"

    def define(self, name: str, binding: object) -> int:
        scope = self.scopes[-1]
        if name in scope.names:
            return scope.names[name]  # the first definition counts
        var = scope.names[name] = len(self.bindings) + 1
        self.bindings[var] = binding
        return var

    def resolve(self, name: str) -> int:
        for scope in reversed(self.scopes):
            if name in scope.names:
                return scope.names[name]
        raise InvalidVariableReferenceError(f"@{name}")

    # -- start and end --

    def start(self) -> State:
        root = navigation.node_columns(self.nodes.where("parent_id IS NULL"), "n0").withColumnRenamed("n0__doc_id", "doc_id").withColumn("__ord", F.array().cast("array<int>"))
        return State(root, {0: Value("node", "n0")}, "n0")

    def run(self, body: s.Body) -> tuple[State, Value]:
        return self.body(body, self.start())

    def body(self, body: s.Body, state: State) -> tuple[State, Value]:
        for b in body.bindings:
            var = self.define(b.variable, b)
            if not self.compat:
                state = self.force_eagerly(var, state)
        if body.where is not None:
            state = self.true_rows(body.where, state)
        return self.value(body.projection, state)

    # -- bindings --

    def force(self, var: int, state: State) -> State:
        """Evaluate a binding at its first use."""
        if var in self.emitted:
            return state
        b = self.bindings.get(var)
        if b is None:
            raise InvalidVariableReferenceError("a variable out of reach")
        self.emitted.add(var)
        e = b.expression
        if isinstance(e, s.Subquery) or isinstance(e, s.Paren) and isinstance(_bare(e), s.Subquery):
            self.scopes.append(Scope())
            state, value = self.subquery(_bare(e).body, state)
            self.scopes.pop()
        elif isinstance(e, s.Call):
            if e.name in self.queries and not self.compat:
                body = self.queries[e.name].body
            elif e.name == "unnest" and len(e.arguments) == 1 and isinstance(_bare(e.arguments[0]), s.Subquery):
                body = _bare(e.arguments[0]).body
            else:
                raise InvalidUnnestArgumentError(e.name)
            self.scopes.append(Scope())
            state, value = self.body(body, state)
            self.scopes.pop()
            if value.form in ("record", "tuple"):
                name = self.fresh("u")
                state, value = replace(state, rows=state.rows.withColumn(name, materialised(value))), Value("built", name, constant=value)
        elif _navigable(e):
            state = self.navigate(e, state)
            value = Value("node", state.cursor)
        elif self.compat:
            value = Value("node", state.cursor)  # a literal or constructor binds the cursor
        else:
            state, value = self.value(e, state)
        return state.bound(var, value)

    def force_eagerly(self, var: int, state: State) -> State:
        b = self.bindings[var]
        if var in self.emitted:
            return state
        if not b.optional or not _navigable(b.expression):
            return self.force(var, state)
        # outer join: probe on the free variables, joined back from the left
        seed, keys = self.seed(b.expression, state)
        found = self.navigate(b.expression, seed)
        self.emitted.add(var)
        name = self.fresh()
        there = found.rows.select(*[F.col(k).alias(f"k__{k}") for k in ("doc_id", *keys)], F.col("__ord").alias("__more"), *[F.col(f"{found.cursor}__{c}").alias(f"{name}__{c}") for c in NODE])
        rows = state.rows.join(there, navigation.same_keys(state.rows, there, keys), "left").drop(*[f"k__{k}" for k in ("doc_id", *keys)])
        rows = rows.withColumn("__ord", F.concat("__ord", F.coalesce("__more", F.array(F.lit(-1))))).drop("__more")
        return replace(state, rows=rows, wide=None).bound(var, Value("node", name))

    # -- navigation --

    def navigate(self, e, state: State) -> State:
        """Move the cursor along a navigation; rows multiply or die with what it reaches."""
        match e:
            case s.Paren():
                return self.navigate(e.inner, state)
            case s.Variable():
                var = self.resolve(e.name)
                state = self.force(var, state)
                value = state.env.get(var, NOTHING)
                if value.form == "nothing":
                    return replace(state, rows=state.rows.where(F.lit(False)))
                if value.form != "node":
                    raise UnexpectedTypeError(f"@{e.name} is a {value.form}, no node")
                return replace(state, rows=state.rows.where(F.col(f"{value.name}__node_id").isNotNull()), cursor=value.name)
            case s.NodeSelector():
                return replace(state, rows=state.rows.where(F.col(f"{state.cursor}__kind") == e.kind))
            case s.FieldAccess():
                state = self.navigate(e.base, state)
                return self.stepped(state, "field", field=e.field)
            case s.Child() | s.Descendant():
                axis, left, right = ("child", e.parent, e.child) if isinstance(e, s.Child) else ("descendant", e.parent, e.descendant)
                state = self.navigate(left, state)
                if isinstance(_bare(right), s.NodeSelector):
                    return self.stepped(state, axis, kind=_bare(right).kind)
                return self.navigate(right, self.stepped(state, axis))
            case s.Call() if not self.compat and e.name in self.queries:
                self.scopes.append(Scope())
                state, value = self.body(self.queries[e.name].body, state)
                self.scopes.pop()
                if value.form != "node":
                    raise UnexpectedTypeError(e.name)
                return replace(state, cursor=value.name)
            case s.Call():
                raise InvalidUnnestArgumentError(e.name)
        raise UnsupportedQueryError(f"{type(e).__name__} where a navigation is needed")

    def stepped(self, state: State, axis: str, **test) -> State:
        name = self.fresh()
        step = lambda rows: navigation.step(rows, self.nodes, state.cursor, name, axis, **test)
        wide = step(state.wide) if state.wide is not None and f"{state.cursor}__node_id" in state.wide.columns else None
        return State(step(state.rows), state.env, name, wide)

    # -- probes --

    def free(self, x, seen: set[str] | None = None) -> set[int]:
        """Variables with a value that evaluating x may read."""
        out: set[int] = set()
        if isinstance(x, s.Variable):
            try:
                var = self.resolve(x.name)
            except InvalidVariableReferenceError:
                return out
            if var in self.emitted:
                return {var}
            b = self.bindings.get(var)
            return self.free(b.expression) if b is not None else out
        if isinstance(x, s.Quantified):
            return self.free(x.source) | self.free(x.predicate)
        if isinstance(x, tuple | list):
            for y in x:
                out |= self.free(y)
        elif hasattr(x, "__dataclass_fields__"):
            for f in x.__dataclass_fields__:
                v = getattr(x, f)
                if not isinstance(v, str | int | bool | None):
                    out |= self.free(v)
            if isinstance(x, s.Call) and x.name in self.queries:
                out |= self.free(self.queries[x.name].body)
        return out

    def seed(self, x, state: State) -> tuple[State, list[str]]:
        """Distinct values of what x reads, as the rows that a probe starts from, and the columns that tell them apart."""
        read = {v: state.env[v] for v in self.free(x) if v in state.env and state.env[v].form not in ("nothing", "string", "uint")}
        nodes = {v.name for v in read.values() if v.form == "node"}
        if _reads_cursor(x):
            nodes.add(state.cursor)
        others = [v.name for v in read.values() if v.form != "node"]
        keys = sorted(f"{n}__node_id" for n in nodes) + sorted(others)
        carried = [f"{n}__{c}" for n in sorted(nodes) for c in NODE] + sorted(others)
        rows = state.rows if state.wide is None or not {*carried} <= {*state.wide.columns} else state.wide
        rows = rows.select("doc_id", *carried).dropDuplicates(["doc_id", *keys]).withColumn("__ord", F.array().cast("array<int>"))
        env = {v: state.env[v] for v in state.env if v in read or state.env[v].form in ("nothing", "string", "uint")}
        return State(rows, env, state.cursor if _reads_cursor(x) else next(iter(sorted(nodes)), state.cursor)), keys

    def subquery(self, body: s.Body, state: State) -> tuple[State, Value]:
        """All projections of the body as a list, for each row."""
        seed, keys = self.seed(body, state)
        found, value = self.body(body, seed)
        name = self.fresh("l")
        rows = navigation.collect(state.rows, found.rows, keys, materialised(value), name)
        return state.probed(rows), Value("list", name, (value,))

    # -- predicates --

    def true_rows(self, p, state: State) -> State:
        return self.split(p, state, False)[0]

    def split(self, p, state: State, both: bool = True) -> tuple[State, State | None]:
        """Rows for which p holds and, if wanted, those for which it fails; rows in neither are dead."""
        match p:
            case s.ParenPredicate():
                return self.split(p.inner, state, both)
            case s.And():
                yes, no = self.split(p.left, state, both)
                yes2, no2 = self.split(p.right, yes, both)
                return yes2, self.union(no, no2) if both else None
            case s.Or():
                plain = self.plain(p, state)
                if plain is not None:
                    return self.cut(state, plain, both)
                yes, no = self.split(p.left, state)
                yes2, no2 = self.split(p.right, no, both)
                return self.union(yes, yes2), no2
            case s.Not():
                inner = p.predicate
                if isinstance(inner, s.Quantified) and self.compat:
                    return self.quantified(inner, state, both, negated=True)
                yes, no = self.split(inner, state)
                return no, yes
            case s.Quantified():
                return self.quantified(p, state, both, negated=False)
            case s.IsNull():
                return self.is_null(p, state, both)
            case s.Comparison():
                return self.comparison(p, state, both)
        raise UnsupportedQueryError(type(p).__name__)

    @staticmethod
    def cut(state: State, test: Column, both: bool) -> tuple[State, State | None]:
        return replace(state, rows=state.rows.where(test)), replace(state, rows=state.rows.where(~test)) if both else None

    def union(self, a: State, b: State) -> State:
        """The rows of both; a variable that only one has reads as nothing in the other's rows."""
        rows, env = {}, {}
        columns: list[set[str]] = [set(), set()]
        renames: list[dict[str, Column]] = [{}, {}]
        for var in sorted(a.env.keys() | b.env.keys()):
            x, y = a.env.get(var, NOTHING), b.env.get(var, NOTHING)
            if x == y:
                env[var] = x
                for side in (0, 1):
                    columns[side] |= {f"{x.name}__{c}" for c in NODE} if x.form == "node" else ({x.name} if x.name else set())
                continue
            form = x if x.form != "nothing" else y
            if {x.form, y.form} - {"nothing", form.form}:
                raise UnsupportedQueryError("a variable with two kinds of values")
            name = self.fresh()
            env[var] = replace(form, name=name)
            for side, v, other in ((0, x, y), (1, y, x)):
                own = v if v.form != "nothing" else other
                for suffix in [f"__{c}" for c in NODE] if form.form == "node" else [""]:
                    have = v.form != "nothing"
                    kind = (a if own is x else b).rows.schema[f"{own.name}{suffix}"].dataType
                    renames[side][f"{name}{suffix}"] = F.col(f"{v.name}{suffix}") if have else F.lit(None).cast(kind)
        cursor = self.fresh()
        for side, st in ((0, a), (1, b)):
            for c in NODE:
                renames[side][f"{cursor}__{c}"] = F.col(f"{st.cursor}__{c}")
        sides = [st.rows.select("doc_id", "__ord", *sorted(columns[k]), *[renames[k][n].alias(n) for n in sorted(renames[k])]) for k, st in enumerate((a, b))]
        rows = sides[0].unionByName(sides[1])
        return State(rows, env, cursor)

    def plain(self, p, state: State) -> Column | None:
        """p as one boolean column, null where the row is dead; None if it needs joins."""
        match p:
            case s.ParenPredicate():
                return self.plain(p.inner, state)
            case s.And() | s.Or():
                left, right = self.plain(p.left, state), self.plain(p.right, state)
                if left is None or right is None:
                    return None
                return F.when(left.isNull(), F.lit(None).cast("boolean")).otherwise(left & right if isinstance(p, s.And) else left | right)
            case s.Not():
                inner = None if isinstance(p.predicate, s.Quantified) else self.plain(p.predicate, state)
                return None if inner is None else ~inner
            case s.Comparison():
                for side in (p.left, p.right):
                    if isinstance(side, s.Variable):
                        var = self.resolve(side.name)
                        if var not in state.env:
                            return None
                    elif _navigable(side) or isinstance(_bare(side), s.Subquery | s.Call | s.Record | s.Array | s.Tuple):
                        return None
                return self.test(p, state)[1]
        return None

    def operand(self, e, state: State) -> tuple[State, Value]:
        if isinstance(e, s.Variable):
            var = self.resolve(e.name)
            state = self.force(var, state)
            return state, state.env.get(var, NOTHING)
        if _navigable(e):
            state = self.navigate(e, state)
            return state, Value("node", state.cursor)
        return self.value(e, state)

    def test(self, p: s.Comparison, state: State) -> tuple[State, Column]:
        """The comparison as a column, after whatever joins its operands need."""
        if isinstance(p.right, s.Text | s.Regex):
            if not _navigable(p.left):
                raise UnsupportedQueryError("a literal compared with a literal")
            state, left = self.operand(p.left, state)
            if left.form not in ("node", "nothing"):
                raise UnexpectedTypeError(f"text of a {left.form}")
            if left.form == "nothing":
                return state, F.lit(None).cast("boolean")
            state = replace(state, cursor=left.name)
            text = F.col(f"{left.name}__text")
            alive = F.col(f"{left.name}__node_id").isNotNull()
            if isinstance(p.right, s.Regex):
                if p.operator not in ("~", "!~"):
                    raise UnsupportedQueryError(f"{p.operator} with a regular expression")
                found = F.coalesce(text, F.lit("")).rlike(checked_regex(p.right.pattern))
                return state, F.when(alive, found if p.operator == "~" else ~found)
            if self.compat or p.operator == "=":
                return state, F.when(alive, F.coalesce(text, F.lit("")) == p.right.value)
            if p.operator == "!=":
                return state, F.when(alive, F.coalesce(text, F.lit("")) != p.right.value)
            raise InvalidArgumentsError(f"{p.operator} with a string")
        state, left = self.operand(p.left, state)
        state, right = self.operand(p.right, state)
        if p.operator in ("~", "!~"):
            raise InvalidArgumentsError("~ needs a regular expression on its right")
        if p.operator in ("=", "!="):
            equal = self.equal(left, right)
            return state, equal if p.operator == "=" else ~equal
        if p.operator in (">=", "<=") and self.compat:
            raise UnsupportedQueryError(p.operator)
        numbers = [self.number(v) for v in (left, right)]
        return state, {"<": numbers[0] < numbers[1], ">": numbers[0] > numbers[1], "<=": numbers[0] <= numbers[1], ">=": numbers[0] >= numbers[1]}[p.operator]

    def number(self, v: Value) -> Column:
        if v.form == "uint":
            return F.lit(v.constant).cast("long")
        if v.form == "node" and not self.compat:
            return F.col(f"{v.name}__text").try_cast("long")
        raise InvalidArgumentsError(f"{v.form} is no number")

    @staticmethod
    def equal(a: Value, b: Value) -> Column:
        if "nothing" in (a.form, b.form):
            other = b if a.form == "nothing" else a
            if other.form == "nothing":
                return F.lit(True)
            return F.col(f"{other.name}__node_id").isNull() if other.form == "node" else F.lit(False)
        if a.form == b.form == "node":
            return F.col(f"{a.name}__node_id").eqNullSafe(F.col(f"{b.name}__node_id"))
        if a.form == b.form and a.form in ("uint", "string"):
            return F.lit(a.constant == b.constant)
        return F.lit(False)  # other kinds are equal by identity only

    def comparison(self, p: s.Comparison, state: State, both: bool) -> tuple[State, State | None]:
        lifted = any(_navigable(x) and not isinstance(x, s.Variable) for x in (p.left, p.right))
        if lifted and not self.compat:
            # a navigation in a plain boolean: some node it reaches passes
            seed, keys = self.seed(p, state)
            if any(isinstance(x, s.Null) for x in (p.left, p.right)):
                nav = p.left if isinstance(p.right, s.Null) else p.right
                reached = self.navigate(nav, seed).rows
                yes, no = (navigation.probe(state.rows, reached, keys, p.operator == "!="), navigation.probe(state.rows, reached, keys, p.operator != "!="))
            else:
                after, test = self.test(p, seed)
                passed = after.rows.where(test)
                yes, no = navigation.probe(state.rows, passed, keys, True), navigation.probe(state.rows, passed, keys, False)
            return state.probed(yes), state.probed(no) if both else None
        state, test = self.test(p, state)
        if not self.compat:
            test = F.coalesce(test, F.lit(False))
        return self.cut(state, test, both)

    def is_null(self, p: s.IsNull, state: State, both: bool) -> tuple[State, State | None]:
        if not _navigable(p.expression):
            raise UnsupportedQueryError("is null needs a navigation")
        state = self.force_bases(p.expression, state)
        seed, keys = self.seed(p.expression, state)
        reached = self.navigate(p.expression, seed).rows
        yes = navigation.probe(state.rows, reached, keys, p.negated)
        if self.compat:
            dead = state.rows.where(F.lit(False))
            return state.probed(yes), replace(state, rows=dead) if both else None
        return state.probed(yes), state.probed(navigation.probe(state.rows, reached, keys, not p.negated)) if both else None

    def force_bases(self, e, state: State) -> State:
        match e:
            case s.Variable():
                return self.force(self.resolve(e.name), state)
            case s.Paren():
                return self.force_bases(e.inner, state)
            case s.FieldAccess():
                return self.force_bases(e.base, state)
            case s.Child() | s.Descendant():
                return self.force_bases(e.parent, state)
        return state

    def quantified(self, q: s.Quantified, state: State, both: bool, negated: bool) -> tuple[State, State | None]:
        if not _navigable(q.source):
            raise UnsupportedQueryError("a quantifier's source is a navigation")
        state = self.force_bases(q.source, state)
        seed, keys = self.seed(q, state)
        inside = self.navigate(q.source, seed)
        names = self.scopes[-1].names
        before = names.get(q.variable)
        var = before if before is not None else self.define(q.variable, None)
        had = var in self.emitted
        self.emitted.add(var)
        inside = inside.bound(var, Value("node", inside.cursor))
        yes, no = self.split(q.predicate, inside, q.quantifier == "all")
        if before is None:
            del names[q.variable]
        if not had:
            self.emitted.discard(var)
        counter = no if q.quantifier == "all" else yes
        exists = (q.quantifier == "any") != negated
        true = navigation.probe(state.rows, counter.rows, keys, exists)
        if not both:
            return state.probed(true), None
        false = state.rows.where(F.lit(False)) if self.compat else navigation.probe(state.rows, counter.rows, keys, not exists)
        return state.probed(true), state.probed(false)

    # -- values --

    def value(self, e, state: State) -> tuple[State, Value]:
        match e:
            case s.Paren():
                return self.value(e.inner, state)
            case s.Variable():
                var = self.resolve(e.name)
                state = self.force(var, state)
                return state, state.env.get(var, NOTHING)
            case s.NodeSelector() | s.FieldAccess() | s.Child() | s.Descendant():
                state = self.navigate(e, state)
                return state, Value("node", state.cursor)
            case s.Text():
                return state, Value("string", constant=e.value)
            case s.Number():
                return state, Value("uint", constant=e.value)
            case s.Null():
                return state, NOTHING
            case s.Regex():
                return state, Value("regex", constant=checked_regex(e.pattern))
            case s.Record():
                got: dict[str, Value] = {}
                for key, x in e.entries:
                    state, got[key or x.name] = self.value(x, state)
                return state, Value("record", parts=tuple(sorted(got.items())))
            case s.Array() | s.Tuple():
                items = []
                for x in e.items:
                    state, v = self.value(x, state)
                    items.append(v)
                return state, Value("tuple", parts=tuple(items))
            case s.Subquery():
                return self.subquery(e.body, state)
            case s.Call() if not self.compat and e.name in self.queries:
                self.scopes.append(Scope())
                out = self.body(self.queries[e.name].body, state)
                self.scopes.pop()
                return out
            case s.Call():
                raise UnsupportedQueryError(f"{e.name}() as a value")
        raise UnsupportedQueryError(type(e).__name__)


def _bare(e):
    while isinstance(e, s.Paren):
        e = e.inner
    return e


def _navigable(e) -> bool:
    return isinstance(_bare(e), s.NAVIGATION)


def _reads_cursor(x) -> bool:
    """Whether a navigation in x begins at the cursor, with a bare selector."""
    match x:
        case s.NodeSelector():
            return True
        case s.Child():
            return _reads_cursor(x.parent)
        case s.Descendant():
            return _reads_cursor(x.parent)
        case s.FieldAccess():
            return _reads_cursor(x.base)
    if isinstance(x, tuple | list):
        return any(map(_reads_cursor, x))
    if hasattr(x, "__dataclass_fields__"):
        return any(_reads_cursor(getattr(x, f)) for f in x.__dataclass_fields__)
    return False
