"""Recursive descent over the tokens. Only a query can be parsed."""

from __future__ import annotations

from ..errors import AdqlSyntaxError, UnsupportedAdqlError
from . import tree as t
from .lexer import RESERVED, Token, tokens

STATEMENTS = frozenset(
    (
        "COPY ATTACH DETACH INSTALL LOAD PRAGMA SET RESET DROP INSERT UPDATE DELETE CREATE MERGE ALTER TRUNCATE EXPORT "
        "IMPORT CALL EXECUTE EXPLAIN DESCRIBE SHOW USE VACUUM GRANT REVOKE CACHE REFRESH ANALYZE ADD"
    ).split()
)
JOIN_WORDS = ("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "JOIN")
UNSUPPORTED_SOURCES = ("LATERAL", "ASOF", "POSITIONAL", "UNNEST", "QUALIFY")
TYPES = {
    "SMALLINT": "SMALLINT",
    "INT": "INT",
    "INTEGER": "INT",
    "BIGINT": "BIGINT",
    "REAL": "FLOAT",
    "FLOAT": "FLOAT",
    "DOUBLE": "DOUBLE",
    "CHAR": "STRING",
    "VARCHAR": "STRING",
    "TIMESTAMP": "TIMESTAMP",
    "DATE": "DATE",
    "BOOLEAN": "BOOLEAN",
}


def parse(text: str, set_operations: bool = False) -> t.Node:
    """The one query of ``text``; a set operation at its root is an extension
    that has to be asked for."""
    return _Parser(text).statement(set_operations)


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens = tokens(text)
        self.i = 0

    # -- tokens ---------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        self.i = min(self.i + 1, len(self.tokens) - 1)
        return token

    def word(self, *words: str) -> str:
        """Takes one of ``words`` if it comes next."""
        if self.now.word in words:
            return self.take().word
        return ""

    def op(self, *ops: str) -> str:
        if self.now.kind == "op" and self.now.text in ops:
            return self.take().text
        return ""

    def fail(self, wanted: str = "") -> None:
        got = "end of query" if self.now.kind == "end" else f"'{self.now.text}'"
        raise AdqlSyntaxError(f"Expected {wanted}, got {got}" if wanted else f"Unexpected {got}", self.now.at)

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)

    def need_op(self, op: str) -> None:
        if not self.op(op):
            self.fail(f"'{op}'")

    def name(self, what: str = "a name") -> str:
        if self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in RESERVED:
            return self.take().text
        self.fail(what)

    # -- queries --------------------------------------------------------------
    def statement(self, set_operations: bool) -> t.Node:
        if self.now.word in STATEMENTS:
            raise UnsupportedAdqlError(f"{self.now.word} is not allowed; only a single SELECT query is.")
        query = self.query()
        while self.op(";"):
            if self.now.kind != "end":
                raise UnsupportedAdqlError("Only a single SELECT statement is allowed.")
        if self.now.kind != "end":
            self.fail()
        if isinstance(query, t.SetOperation) and not set_operations:
            raise UnsupportedAdqlError(f"{query.op} at the top level is not supported; only a single SELECT query is.")
        return query

    def query(self) -> t.Node:
        ctes: list[tuple[str, t.Node]] = []
        if self.word("WITH"):
            while True:
                name = self.name("a name for the WITH query")
                self.need_word("AS")
                self.need_op("(")
                ctes.append((name, self.query()))
                self.need_op(")")
                if not self.op(","):
                    break
        out = self.set_operand()
        while op := self.word("UNION", "EXCEPT", "INTERSECT"):
            every = bool(self.word("ALL"))
            if not every:
                self.word("DISTINCT")
            out = t.SetOperation(op, every, out, self.set_operand())
        self.tail(out)
        out.ctes = ctes + out.ctes
        return out

    def set_operand(self) -> t.Node:
        if self.op("("):
            out = self.query()
            self.need_op(")")
            return out
        return self.select()

    def tail(self, out) -> None:
        if self.word("ORDER"):
            self.need_word("BY")
            out.order = self.orderings()
        if self.word("LIMIT"):
            out.limit = self.integer()
        if self.word("OFFSET"):
            out.offset = self.integer()
        if self.now.word == "QUALIFY":
            raise UnsupportedAdqlError("QUALIFY is not supported.")

    def integer(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            self.fail("a whole number")
        return int(self.take().text)

    def select(self) -> t.Select:
        if self.now.word in STATEMENTS:
            raise UnsupportedAdqlError(f"{self.now.word} is not allowed; only a single SELECT query is.")
        self.need_word("SELECT")
        out = t.Select([])
        if not self.word("ALL"):
            out.distinct = bool(self.word("DISTINCT"))
        if self.word("TOP"):
            out.limit = self.integer()
        out.items.append(self.item())
        while self.op(","):
            out.items.append(self.item())
        if self.word("FROM"):
            out.source = self.sources()
        if self.word("WHERE"):
            out.where = self.expression()
        if self.word("GROUP"):
            self.need_word("BY")
            out.groups = self.grouping()
        if self.word("HAVING"):
            out.having = self.expression()
        if self.now.word == "QUALIFY":
            raise UnsupportedAdqlError("QUALIFY is not supported.")
        top, out.limit = out.limit, None
        if self.now.word in ("ORDER", "LIMIT", "OFFSET"):
            self.tail(out)
        out.limit = top if out.limit is None else out.limit if top is None else min(top, out.limit)
        return out

    def item(self) -> t.Item:
        if self.op("*"):
            return t.Item(t.Star())
        start = self.i
        if self.now.kind in ("name", "quoted") and self.now.word not in RESERVED:
            parts = [self.name()]
            while self.now.text == "." and self.now.kind == "op":
                self.take()
                if self.op("*"):
                    return t.Item(t.Star(tuple(parts)))
                if self.now.kind not in ("name", "quoted"):
                    break
                parts.append(self.take().text)
            self.i = start
        value = self.expression()
        alias = None
        if self.word("AS"):
            alias = self.name("a column alias")
        elif self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in RESERVED:
            alias = self.take().text
            if self.now.kind == "op" and self.now.text == ".":
                self.fail("FROM")
        return t.Item(value, alias)

    def grouping(self) -> t.Grouping:
        for kind in ("ROLLUP", "CUBE"):
            if self.now.word == kind and self.ahead().text == "(":
                self.take()
                self.take()
                items = self.expressions()
                self.need_op(")")
                return t.Grouping(kind, [items])
        if self.now.word == "GROUPING" and self.ahead().word == "SETS":
            self.take()
            self.take()
            self.need_op("(")
            sets = []
            while True:
                self.need_op("(")
                sets.append([] if self.now.text == ")" else self.expressions())
                self.need_op(")")
                if not self.op(","):
                    break
            self.need_op(")")
            return t.Grouping("SETS", sets)
        return t.Grouping("", [self.expressions()])

    def orderings(self) -> list[t.Ordering]:
        out = []
        while True:
            value = self.expression()
            out.append(t.Ordering(value, self.word("ASC", "DESC") == "DESC"))
            if not self.op(","):
                return out

    # -- sources --------------------------------------------------------------
    def sources(self) -> t.Node:
        out = self.joined()
        while self.op(","):
            out = t.Join(out, self.joined(), ",")
        return out

    def joined(self) -> t.Node:
        out = self.source()
        while self.now.word in JOIN_WORDS + UNSUPPORTED_SOURCES:
            if self.now.word in UNSUPPORTED_SOURCES:
                raise UnsupportedAdqlError(f"{self.now.word} is not supported.")
            natural = bool(self.word("NATURAL"))
            kind = self.word("INNER", "LEFT", "RIGHT", "FULL", "CROSS") or "INNER"
            if kind in ("LEFT", "RIGHT", "FULL"):
                self.word("OUTER")
            self.need_word("JOIN")
            join = t.Join(out, self.source(), kind, natural)
            if kind != "CROSS" and not natural:
                if self.word("ON"):
                    join.on = self.expression()
                elif self.word("USING"):
                    self.need_op("(")
                    join.using.append(self.name())
                    while self.op(","):
                        join.using.append(self.name())
                    self.need_op(")")
                else:
                    self.fail("ON or USING")
            out = join
        return out

    def source(self) -> t.Node:
        if self.now.word in UNSUPPORTED_SOURCES:
            raise UnsupportedAdqlError(f"{self.now.word} is not supported.")
        if self.now.kind == "string":
            raise UnsupportedAdqlError("A file path is no table; only registered tables can be queried.")
        if self.op("("):
            if self.now.word in ("SELECT", "WITH") or self.now.text == "(":
                query = self.query()
                self.need_op(")")
                return t.Derived(query, self.alias())
            inner = self.sources()
            self.need_op(")")
            return inner
        at = self.now.at
        parts = [self.name("a table name")]
        while self.op("."):
            parts.append(self.name("a table name"))
        if self.now.kind == "op" and self.now.text == "(":
            raise UnsupportedAdqlError(f"Table function {'.'.join(parts)} is not allowed.")
        return t.Table(tuple(parts), self.alias(), at)

    def alias(self) -> str | None:
        if self.word("AS"):
            return self.name("a table alias")
        if self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in RESERVED:
            return self.take().text
        return None

    # -- expressions ----------------------------------------------------------
    def expressions(self) -> list[t.Node]:
        out = [self.expression()]
        while self.op(","):
            out.append(self.expression())
        return out

    def expression(self) -> t.Node:
        out = self.conjunction()
        while self.word("OR"):
            out = t.Binary("OR", out, self.conjunction())
        return out

    def conjunction(self) -> t.Node:
        out = self.negation()
        while self.word("AND"):
            out = t.Binary("AND", out, self.negation())
        return out

    def negation(self) -> t.Node:
        if self.word("NOT"):
            return t.Unary("NOT", self.negation())
        return self.predicate()

    def predicate(self) -> t.Node:
        left = self.sum()
        while True:
            if op := self.op("=", "<>", "!=", "<", ">", "<=", ">="):
                left = t.Binary("<>" if op == "!=" else op, left, self.sum())
                continue
            if self.word("IS"):
                negated = bool(self.word("NOT"))
                self.need_word("NULL")
                left = t.IsNull(left, negated)
                continue
            negated = False
            if self.now.word == "NOT" and self.ahead().word in ("BETWEEN", "IN", "LIKE", "ILIKE"):
                self.take()
                negated = True
            if self.word("BETWEEN"):
                low = self.sum()
                self.need_word("AND")
                left = t.Between(left, low, self.sum(), negated)
            elif self.word("IN"):
                self.need_op("(")
                if self.now.word in ("SELECT", "WITH"):
                    items: list[t.Node] = [t.Subquery(self.query())]
                else:
                    items = self.expressions()
                self.need_op(")")
                left = t.In(left, items, negated)
            elif word := self.word("LIKE", "ILIKE"):
                left = t.Like(left, self.sum(), negated, word == "ILIKE")
            else:
                return left

    def sum(self) -> t.Node:
        out = self.product()
        while op := self.op("+", "-", "||"):
            out = t.Binary(op, out, self.product())
        return out

    def product(self) -> t.Node:
        out = self.factor()
        while op := self.op("*", "/", "%"):
            out = t.Binary(op, out, self.factor())
        return out

    def factor(self) -> t.Node:
        if op := self.op("-", "+"):
            return t.Unary(op, self.factor())
        return self.primary()

    def primary(self) -> t.Node:
        token = self.now
        if token.kind == "number":
            return t.Number(self.take().text)
        if token.kind == "string":
            return t.Text(self.take().text)
        if word := self.word("NULL", "TRUE", "FALSE"):
            return t.Constant(word)
        if self.word("CASE"):
            return self.case()
        if self.word("CAST"):
            return self.cast()
        if self.word("EXISTS"):
            self.need_op("(")
            out = t.Exists(self.query())
            self.need_op(")")
            return out
        if self.op("("):
            if self.now.word in ("SELECT", "WITH"):
                out = t.Subquery(self.query())
            else:
                out = self.expression()
            self.need_op(")")
            return out
        if (token.kind == "name" and (token.word not in RESERVED or token.word in ("LEFT", "RIGHT", "TOP"))) and (
            self.ahead().kind == "op" and self.ahead().text == "("
        ):
            return self.call()
        if token.kind == "quoted" or token.kind == "name" and token.word not in RESERVED:
            parts = [self.take().text]
            while self.op("."):
                if self.now.kind not in ("name", "quoted"):
                    self.fail("a column name")
                parts.append(self.take().text)
            if len(parts) > 1 and self.now.kind == "op" and self.now.text == "(":
                raise UnsupportedAdqlError(f"Function {'.'.join(parts)} is not supported.")
            return t.Column(tuple(parts), token.at)
        self.fail("an expression")

    def case(self) -> t.Node:
        base = None if self.now.word == "WHEN" else self.expression()
        whens = []
        while self.word("WHEN"):
            test = self.expression()
            self.need_word("THEN")
            whens.append((test, self.expression()))
        if not whens:
            self.fail("WHEN")
        default = self.expression() if self.word("ELSE") else None
        self.need_word("END")
        return t.Case(base, whens, default)

    def cast(self) -> t.Node:
        self.need_op("(")
        value = self.expression()
        self.need_word("AS")
        at = self.now
        kind = TYPES.get(self.take().word)
        if not kind:
            raise AdqlSyntaxError(f"Unknown type '{at.text}'", at.at)
        if at.word == "DOUBLE":
            self.word("PRECISION")
        if self.op("("):
            self.integer()
            self.need_op(")")
        self.need_op(")")
        return t.Cast(value, kind)

    def call(self) -> t.Node:
        name = self.take()
        self.need_op("(")
        out = t.Call(name.text.upper(), [], name.at)
        if not self.op(")"):
            if self.op("*"):
                out.args.append(t.Star())
            else:
                out.distinct = bool(self.word("DISTINCT"))
                out.args = self.expressions()
            self.need_op(")")
        if self.word("OVER"):
            self.need_op("(")
            partition, order, frame = [], [], ""
            if self.word("PARTITION"):
                self.need_word("BY")
                partition = self.expressions()
            if self.word("ORDER"):
                self.need_word("BY")
                order = self.orderings()
            if self.now.word in ("ROWS", "RANGE"):
                frame = self.frame()
            self.need_op(")")
            out.over = t.Over(partition, order, frame)
        return out

    def frame(self) -> str:
        unit = self.take().word

        def bound() -> str:
            if self.word("UNBOUNDED"):
                return "UNBOUNDED " + (self.word("PRECEDING", "FOLLOWING") or self.fail("PRECEDING or FOLLOWING"))
            if self.word("CURRENT"):
                self.need_word("ROW")
                return "CURRENT ROW"
            return f"{self.integer()} " + (self.word("PRECEDING", "FOLLOWING") or self.fail("PRECEDING or FOLLOWING"))

        if self.word("BETWEEN"):
            low = bound()
            self.need_word("AND")
            return f"{unit} BETWEEN {low} AND {bound()}"
        return f"{unit} {bound()}"
