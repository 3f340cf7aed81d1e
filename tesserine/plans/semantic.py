"""Checks of a syntax tree: scopes, kinds of variables, operators and patterns."""

from __future__ import annotations

from . import tree as t
from .errors import QueryError

BOOLEAN_OPS = frozenset(("AND", "OR", "XOR", "NOT"))
PREDICATES = frozenset(("=", "<>", "<", "<=", ">", ">=", "IN", "CONTAINS", "STARTS WITH", "ENDS WITH", "=~", "@@", "IS NULL", "IS NOT NULL")) | BOOLEAN_OPS


def fail(code: str, message: str, at: tuple[int, int] = (0, 0)) -> None:
    raise QueryError("semantic", code, message, *at)


def kind_of(e, scope: dict[str, str]) -> str:
    """boolean, integer, float, string, list, map, null, node, edge or any."""
    if isinstance(e, t.Literal):
        v = e.value
        return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
    if isinstance(e, t.ListOf):
        return "list"
    if isinstance(e, t.MapOf):
        return "map"
    if isinstance(e, t.Name):
        return scope.get(e.name, "any")
    if isinstance(e, (t.Binary, t.Unary)) and e.op in PREDICATES:
        return "boolean"
    return "any"


def check_expr(e, scope: dict[str, str], aggregates: bool = False) -> None:
    if isinstance(e, t.Name) and e.name not in scope:
        fail("unbound_variable", f"variable {e.name!r} is not bound", e.at)
    if t.is_aggregate(e):
        if not aggregates:
            fail("internal_error", f"{e.name}() is allowed in WITH and RETURN only", e.at)
        for a in e.args:
            check_expr(a, scope, False)
        return
    for c in t.children(e):
        check_expr(c, scope, aggregates)
    if isinstance(e, t.Binary):
        kinds = [kind_of(x, scope) for x in (e.left, e.right)]
        if e.op in BOOLEAN_OPS and any(k not in ("boolean", "any", "null") for k in kinds):
            fail("invalid_operator_types", f"{e.op} needs boolean operands", e.at)
        if e.op in ("-", "*", "/", "%", "^") and any(k in ("string", "boolean", "list", "map", "node", "edge") for k in kinds):
            fail("invalid_operator_types", f"{e.op} needs numbers", e.at)
        if e.op == "+" and any(k in ("boolean", "map", "node", "edge") for k in kinds):
            fail("invalid_operator_types", "+ needs numbers or strings", e.at)
    if isinstance(e, t.Unary) and e.op == "NOT" and kind_of(e.arg, scope) not in ("boolean", "any", "null"):
        fail("invalid_operator_types", "NOT needs a boolean operand")


def check_where(e, scope: dict[str, str]) -> None:
    if e is None:
        return
    check_expr(e, scope)
    if kind_of(e, scope) not in ("boolean", "any", "null"):
        fail("non_boolean_condition", "a WHERE condition must be boolean")


def check_count(e, name: str) -> None:
    if e is None:
        return
    if any(isinstance(x, (t.Name, t.Prop)) for x in t.walk(e)):
        fail("non_integer_limit", f"{name} can't depend on variables")
    if kind_of(e, {}) in ("boolean", "float", "string", "list", "map", "null"):
        fail("non_integer_limit", f"{name} must be an integer")
    if isinstance(e, t.Literal) and e.value < 0:
        fail("non_integer_limit", f"{name} can't be negative")


def check_path(path: t.Path, scope: dict[str, str], made: bool) -> None:
    """Binds a pattern's variables. Nodes met before are joined on; an edge
    variable, or any variable that is no node, can't be bound again."""
    before = dict(scope)
    for part in path.parts:
        want = "node" if isinstance(part, t.NodePattern) else "edge"
        if part.var is not None:
            have = scope.get(part.var)
            if have is not None and (have != want or want == "edge"):
                fail("duplicate_variable", f"variable {part.var!r} is bound already", part.at)
            if made and have is not None and (part.props or getattr(part, "labels", ())):
                fail("duplicate_variable", f"variable {part.var!r} is bound already", part.at)
            scope[part.var] = want
        if want == "edge":
            if part.hops is not None and (part.var is not None or part.props):
                fail("unsupported_pattern", "a variable-length relationship has no variable and no properties", part.at)
            if made and (part.hops is not None or len(part.types) != 1 or part.direction == "both"):
                fail("unsupported_pattern", "a relationship that is created needs one type and a direction", part.at)
    for part in path.parts:
        for _, e in part.props:
            check_expr(e, before if made else scope)


def check_set(items: list, scope: dict[str, str], only: set[str] | None = None) -> None:
    for i in items:
        kind = scope.get(i.var)
        if kind is None:
            fail("unbound_variable", f"variable {i.var!r} is not bound")
        if kind not in ("node", "edge", "any"):
            fail("invalid_set_target", f"{i.var!r} is no node or relationship")
        if only is not None and i.var not in only:
            fail("invalid_set_target", "ON CREATE and ON MATCH set the merged element only")
        if isinstance(i, t.SetLabels) and kind == "edge":
            fail("invalid_set_target", "relationships have no labels")
        if isinstance(i, (t.SetProperty, t.SetMap)):
            check_expr(i.value, scope)
        if isinstance(i, t.SetMap) and kind_of(i.value, scope) not in ("map", "any"):
            fail("invalid_set_target", "a map is needed")


def analyze(query: t.Query) -> None:
    scope: dict[str, str] = {}
    for n, c in enumerate(query.clauses):
        if isinstance(c, t.Match):
            for p in c.paths:
                check_path(p, scope, False)
            check_where(c.where, scope)
        elif isinstance(c, t.Unwind):
            check_expr(c.expr, scope)
            if c.var in scope:
                fail("duplicate_variable", f"variable {c.var!r} is bound already")
            scope[c.var] = "any"
        elif isinstance(c, t.Projection):
            if c.final and n + 1 < len(query.clauses):
                fail("internal_error", "RETURN must be the last clause")
            inner: dict[str, str] = dict(scope) if c.star else {}
            for i in c.items:
                check_expr(i.expr, scope, True)
                if not c.final and i.alias is None and not isinstance(i.expr, t.Name):
                    fail("internal_error", "an expression in WITH needs an alias")
                name = i.alias or (i.expr.name if isinstance(i.expr, t.Name) else i.text)
                if name in inner and not c.final:
                    fail("duplicate_variable", f"variable {name!r} is bound already")
                inner[name] = scope.get(i.expr.name, "any") if isinstance(i.expr, t.Name) else "any"
            both = scope | inner
            for o in c.order:
                check_expr(o.expr, both, True)
            check_count(c.skip, "SKIP")
            check_count(c.limit, "LIMIT")
            check_where(c.where, inner)
            scope = inner
        elif isinstance(c, t.Create):
            for p in c.paths:
                check_path(p, scope, True)
        elif isinstance(c, t.Merge):
            if len(c.path.parts) not in (1, 3):
                fail("unsupported_pattern", "MERGE takes one node or one relationship")
            target = c.path.parts[1 if len(c.path.parts) == 3 else 0].var
            check_path(c.path, scope, True)
            check_set(c.on_create + c.on_match, scope, {target} if target else set())
            if any(not isinstance(i, t.SetProperty) for i in c.on_create + c.on_match):
                fail("invalid_set_target", "ON CREATE and ON MATCH set properties only")
        elif isinstance(c, t.Delete):
            for e in c.names:
                if not isinstance(e, t.Name):
                    fail("invalid_delete_target", "DELETE takes variables")
                check_expr(e, scope)
                if scope[e.name] not in ("node", "edge", "any"):
                    fail("invalid_delete_target", f"{e.name!r} is no node or relationship", e.at)
        elif isinstance(c, t.Set):
            check_set(c.items, scope)
        elif isinstance(c, t.Remove):
            try:
                check_set(c.items, scope)
            except QueryError as e:
                raise QueryError("semantic", "invalid_remove_target" if e.code == "invalid_set_target" else e.code, e.message) from None
