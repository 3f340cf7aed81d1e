"""Text to syntax tree: a lexer, and a parser by recursive descent with
precedence climbing for expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import tree as t
from .errors import QueryError

KEYWORDS = frozenset(
    "match where return with as and or xor not is null in contains starts ends true false order by asc ascending desc descending skip limit distinct unwind create delete detach set remove merge on optional".split()
)
_LEX = re.compile(
    r"""(?P<space>\s+|//[^\n]*|--(?=[ \t])[^\n]*)
  |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)
  |(?P<int>\d+)
  |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  |(?P<quoted>`[^`]+`)
  |(?P<param>\$[A-Za-z_]\w*)
  |(?P<name>[^\W\d]\w*)
  |(?P<op><=>|<>|!=|<=|>=|=~|\+=|@@|\.\.|<-|->|[-+*/%^=<>()\[\]{},.:|;])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _LEX.match(source, at)
        if m is None:
            raise QueryError("parse", "unexpected_character", f"unexpected character {source[at]!r}", *place(source, at), 1)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup or "", m[0], at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(source), len(source)))
    return out


def place(source: str, at: int) -> tuple[int, int]:
    return source.count("\n", 0, at) + 1, at - (source.rfind("\n", 0, at) + 1) + 1


#: Infix operators by precedence, weakest first.
LEVELS = {"OR": 1, "XOR": 2, "AND": 3, "=": 5, "<>": 5, "!=": 5, "IN": 5, "CONTAINS": 5, "STARTS WITH": 5, "ENDS WITH": 5, "=~": 5, "IS": 5, "<": 6, "<=": 6, ">": 6, ">=": 6, "<=>": 6, "@@": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "^": 9}
NOT_LEVEL, UNARY_LEVEL = 4, 10


class Parser:
    def __init__(self, source: str):
        self.source = source.strip().rstrip(";").rstrip()
        self.tokens, self.i = tokens(self.source), 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, message: str, token: Token | None = None):
        token = token or self.now
        raise QueryError("parse", "syntax", f"{message}, found {token.text or 'the end'!r}", *place(self.source, token.start), max(1, token.end - token.start))

    def at(self, token: Token | None = None) -> tuple[int, int]:
        return place(self.source, (token or self.now).start)

    def word(self, *words: str) -> bool:
        """Whether these keywords come next; takes them if so."""
        for k, w in enumerate(words):
            tok = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if tok.kind != "name" or tok.text.lower() != w:
                return False
        self.i += len(words)
        return True

    def ahead(self, *words: str) -> bool:
        i = self.i
        found = self.word(*words)
        self.i = i
        return found

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}")

    def name(self, what: str = "a name") -> str:
        tok = self.now
        if tok.kind == "quoted":
            self.i += 1
            return tok.text[1:-1]
        if tok.kind == "name":
            self.i += 1
            return tok.text
        self.fail(f"expected {what}")
        raise AssertionError

    def variable(self) -> str:
        if self.now.kind == "name" and self.now.text.lower() in KEYWORDS:
            self.fail("expected a variable")
        return self.name("a variable")

    # clauses
    def query(self) -> t.Query:
        out: list = []
        while self.now.kind != "end":
            out.append(self.clause())
        if not out:
            self.fail("expected a clause")
        return t.Query(out)

    def clause(self):
        if self.word("match"):
            paths = self.paths()
            return t.Match(paths, self.expr() if self.word("where") else None)
        if self.ahead("optional"):
            self.fail("OPTIONAL MATCH is not supported")
        if self.word("unwind"):
            e = self.expr()
            if not self.word("as"):
                self.fail("expected AS")
            return t.Unwind(e, self.variable())
        if self.word("with"):
            p = self.projection()
            if self.word("where"):
                p.where = self.expr()
            return p
        if self.word("return"):
            p = self.projection()
            p.final = True
            return p
        if self.word("create"):
            return t.Create(self.paths())
        if self.word("merge"):
            out = t.Merge(self.path())
            while self.word("on"):
                if self.word("create"):
                    kind = out.on_create
                elif self.word("match"):
                    kind = out.on_match
                else:
                    self.fail("expected CREATE or MATCH")
                if not self.word("set"):
                    self.fail("expected SET")
                kind += self.set_items()
            return out
        if self.word("set"):
            return t.Set(self.set_items())
        if self.word("remove"):
            items = [self.remove_item()]
            while self.op(","):
                items.append(self.remove_item())
            return t.Remove(items)
        detach = self.word("detach")
        if self.word("delete"):
            items = [self.expr()]
            while self.op(","):
                items.append(self.expr())
            return t.Delete(items, detach)
        self.fail("expected a clause")

    def projection(self) -> t.Projection:
        p = t.Projection([], self.word("distinct"))
        if self.op("*"):
            p.star = True
        else:
            p.items.append(self.item())
        while self.op(","):
            p.items.append(self.item())
        if self.word("order", "by"):
            p.order.append(self.order())
            while self.op(","):
                p.order.append(self.order())
        if self.word("skip"):
            p.skip = self.expr()
        if self.word("limit"):
            p.limit = self.expr()
        return p

    def item(self) -> t.Item:
        start = self.now.start
        e = self.expr()
        text = self.source[start : self.tokens[self.i - 1].end]
        return t.Item(e, self.name() if self.word("as") else None, text)

    def order(self) -> t.Order:
        e = self.expr()
        if self.word("desc") or self.word("descending"):
            return t.Order(e, True)
        if not self.word("asc"):
            self.word("ascending")
        return t.Order(e, False)

    def set_items(self) -> list:
        out = [self.set_item()]
        while self.op(","):
            out.append(self.set_item())
        return out

    def set_item(self):
        var = self.variable()
        if self.op("."):
            key = self.name("a property")
            self.need("=")
            return t.SetProperty(var, key, self.expr())
        if self.now.text == ":":
            return t.SetLabels(var, self.labels())
        if self.op("+="):
            return t.SetMap(var, self.expr(), True)
        self.need("=")
        return t.SetMap(var, self.expr(), False)

    def remove_item(self):
        var = self.variable()
        if self.op("."):
            return t.RemoveProperty(var, self.name("a property"))
        if self.now.text == ":":
            return t.SetLabels(var, self.labels())
        self.fail("expected a property or a label")

    # patterns
    def paths(self) -> list[t.Path]:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return out

    def path(self) -> t.Path:
        parts: list = [self.node()]
        while self.now.text in ("-", "<-", "->", "<") and self.now.kind == "op":
            parts.append(self.edge())
            parts.append(self.node())
        return t.Path(tuple(parts))

    def labels(self) -> tuple[str, ...]:
        out = []
        while self.op(":"):
            out.append(self.name("a label"))
        return tuple(out)

    def node(self) -> t.NodePattern:
        at = self.at()
        self.need("(")
        var = self.variable() if self.now.kind in ("name", "quoted") else None
        labels = self.labels()
        props = self.map_items() if self.now.text == "{" else ()
        self.need(")")
        return t.NodePattern(var, labels, props, at)

    def edge(self) -> t.EdgePattern:
        at = self.at()
        left = self.op("<-")
        if not left:
            if self.op("->"):
                return t.EdgePattern(None, (), "out", (), None, at)
            self.need("-")
        var, types, props, hops = None, [], (), None
        if self.op("["):
            if self.now.kind in ("name", "quoted"):
                var = self.variable()
            if self.op(":"):
                types.append(self.name("a type"))
                while self.op("|"):
                    self.op(":")
                    types.append(self.name("a type"))
            if self.op("*"):
                hops = self.quantifier()
            if self.now.text == "{":
                props = self.map_items()
            self.need("]")
            right = self.op("->")
            if not right:
                self.need("-")
                right = False
        else:
            right = self.op("->")
            if not right and not self.op("-"):
                right = False
        direction = "both" if left == right else "in" if left else "out"
        return t.EdgePattern(var, tuple(types), direction, props, hops, at)

    def quantifier(self) -> tuple[int, int | None]:
        """*, *n, *n..m, *n.., *..m."""
        lo = hi = None
        if self.now.kind == "int":
            lo = int(self.now.text)
            self.i += 1
        elif self.now.kind == "float" and re.fullmatch(r"\d+\.", self.now.text):
            self.fail("expected a number of hops")
        if self.op(".."):
            if self.now.kind == "int":
                hi = int(self.now.text)
                self.i += 1
        elif lo is not None:
            hi = lo
        lo = 1 if lo is None else lo
        if hi is not None and hi < lo:
            self.fail("the most hops are fewer than the least")
        return lo, hi

    def map_items(self) -> tuple[tuple[str, t.Expr], ...]:
        self.need("{")
        out: list[tuple[str, t.Expr]] = []
        while not self.op("}"):
            if out:
                self.need(",")
            if self.now.kind == "string":
                key = self.string(self.now.text)
                self.i += 1
            else:
                key = self.name("a key")
            self.need(":")
            if key in dict(out):
                self.fail(f"the key {key!r} is given twice")
            out.append((key, self.expr()))
        return tuple(out)

    # expressions
    def infix(self) -> tuple[str, int] | None:
        tok = self.now
        if tok.kind == "op" and tok.text in LEVELS:
            return tok.text, 1
        if tok.kind == "op" and tok.text == "<-":  # a comparison with a negative number
            return "<", 0
        if tok.kind != "name":
            return None
        for w in ("or", "xor", "and", "in", "contains", "is"):
            if self.ahead(w):
                return w.upper(), 1
        for w in ("starts", "ends"):
            if self.ahead(w, "with"):
                return f"{w.upper()} WITH", 2
        return None

    def expr(self, least: int = 1) -> t.Expr:
        left = self.prefix()
        while (found := self.infix()) is not None and LEVELS[found[0]] >= least:
            op, n = found
            at, level = self.at(), LEVELS[op]
            if n == 0:  # split the token
                tok = self.now
                self.tokens[self.i : self.i + 1] = [Token("op", "<", tok.start, tok.start + 1), Token("op", "-", tok.start + 1, tok.end)]
                n = 1
            self.i += n
            if op == "IS":
                negative = self.word("not")
                if not self.word("null"):
                    self.fail("expected NULL")
                left = t.Unary("IS NOT NULL" if negative else "IS NULL", left)
                continue
            left = t.Binary("<>" if op == "!=" else op, left, self.expr(level if op == "^" else level + 1), at)
        return left

    def prefix(self) -> t.Expr:
        if self.word("not"):
            return t.Unary("NOT", self.expr(NOT_LEVEL))
        if self.op("-"):
            arg = self.expr(UNARY_LEVEL)
            return t.Literal(-arg.value) if isinstance(arg, t.Literal) and type(arg.value) in (int, float) else t.Unary("-", arg)
        if self.op("+"):
            return self.expr(UNARY_LEVEL)
        e = self.primary()
        while self.op("."):
            e = t.Prop(e, self.name("a property"))
        return e

    def string(self, text: str) -> str:
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)

    def primary(self) -> t.Expr:
        tok = self.now
        if tok.kind in ("int", "float", "string", "param"):
            self.i += 1
            if tok.kind == "int":
                if int(tok.text) >= 1 << 63:
                    self.fail("the number is too large", tok)
                return t.Literal(int(tok.text))
            if tok.kind == "float":
                return t.Literal(float(tok.text))
            return t.Literal(self.string(tok.text)) if tok.kind == "string" else t.Param(tok.text[1:])
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if self.op("["):
            items: list[t.Expr] = []
            while not self.op("]"):
                if items:
                    self.need(",")
                items.append(self.expr())
            return t.ListOf(tuple(items))
        if tok.text == "{":
            return t.MapOf(self.map_items())
        if tok.kind in ("name", "quoted"):
            low = tok.text.lower()
            if tok.kind == "name" and low in ("true", "false", "null"):
                self.i += 1
                return t.Literal({"true": True, "false": False, "null": None}[low])
            if tok.kind == "name" and low in KEYWORDS:
                self.fail("expected an expression")
            self.i += 1
            if self.op("("):
                distinct = self.word("distinct")
                if self.op("*"):
                    self.need(")")
                    return t.Call(tok.text, (), distinct, True, self.at(tok))
                args: list[t.Expr] = []
                while not self.op(")"):
                    if args:
                        self.need(",")
                    args.append(self.expr())
                return t.Call(tok.text, tuple(args), distinct, False, self.at(tok))
            return t.Name(tok.text.strip("`"), self.at(tok))
        self.fail("expected an expression")
        raise AssertionError


def parse(source: str) -> t.Query:
    return Parser(source).query()
