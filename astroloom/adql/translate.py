"""The gate and the renderer: a checked tree becomes one Spark SQL statement."""

from __future__ import annotations

import difflib
from collections import defaultdict
from dataclasses import dataclass, field

from ..errors import AdqlSyntaxError, UnknownColumnError, UnknownTableError, UnsupportedAdqlError
from ..functions import sphere
from ..model import TableMeta
from ..plans import cells, shards
from . import tree as t
from .parser import parse


@dataclass(frozen=True)
class ConeHint:
    ra0: float
    dec0: float
    radius_deg: float


@dataclass
class Translation:
    sql: str
    cone_hint: ConeHint | None = None
    #: View -> files: what is left of a sharded table for this query only.
    pruned: dict[str, tuple[TableMeta, list[str]]] = field(default_factory=dict)


#: ADQL function -> Spark SQL template or name. What is not here is refused.
SCALARS = {
    "UPPER": "upper",
    "LOWER": "lower",
    "SUBSTRING": "substring",
    "SUBSTR": "substring",
    "TRIM": "trim",
    "LTRIM": "ltrim",
    "RTRIM": "rtrim",
    "LENGTH": "length",
    "CHAR_LENGTH": "length",
    "CONCAT": "concat",
    "REPLACE": "replace",
    "ABS": "abs",
    "SQRT": "sqrt",
    "POWER": "power",
    "POW": "power",
    "MOD": "try_mod",
    "LOG": "ln",
    "LN": "ln",
    "LOG10": "log10",
    "EXP": "exp",
    "ACOS": "acos",
    "ASIN": "asin",
    "ATAN": "atan",
    "ATAN2": "atan2",
    "COS": "cos",
    "COT": "cot",
    "SIN": "sin",
    "TAN": "tan",
    "DEGREES": "degrees",
    "RADIANS": "radians",
    "PI": "pi",
    "SIGN": "sign",
    "RAND": "rand",
    "COALESCE": "coalesce",
    "NULLIF": "nullif",
    "GREATEST": "greatest",
    "LEAST": "least",
}
AGGREGATES = {
    "COUNT": "count",
    "AVG": "avg",
    "MIN": "min",
    "MAX": "max",
    "SUM": "sum",
    "STDDEV": "stddev_samp",
    "STDDEV_SAMP": "stddev_samp",
    "STDDEV_POP": "stddev_pop",
    "VARIANCE": "var_samp",
    "VAR_SAMP": "var_samp",
    "VAR_POP": "var_pop",
    "MEDIAN": "median",
    "CORR": "corr",
    "COVAR_POP": "covar_pop",
    "COVAR_SAMP": "covar_samp",
    "APPROX_COUNT_DISTINCT": "approx_count_distinct",
    "GROUPING": "grouping",
}
WINDOWS = {
    "ROW_NUMBER": "row_number",
    "RANK": "rank",
    "DENSE_RANK": "dense_rank",
    "PERCENT_RANK": "percent_rank",
    "CUME_DIST": "cume_dist",
    "NTILE": "ntile",
    "LAG": "lag",
    "LEAD": "lead",
    "FIRST_VALUE": "first_value",
    "LAST_VALUE": "last_value",
}
#: Ranks and tiles are 64-bit numbers.
COUNTING = ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE")
SHAPES = {"POINT": 3, "CIRCLE": 4}
PREDICATES = ("CONTAINS", "INTERSECTS")
REFUSED = ("BOX", "REGION")
NOT_PROVIDED = ("IN_UNIT", "CENTROID", "AREA", "BITWISE_AND", "BITWISE_OR", "BITWISE_XOR", "BITWISE_NOT")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_number(node: t.Node) -> float | None:
    if isinstance(node, t.Number):
        return float(node.text)
    if isinstance(node, t.Unary) and node.op in "+-" and (x := literal_number(node.value)) is not None:
        return -x if node.op == "-" else x
    return None


# --- geometry rules -----------------------------------------------------------


def check_geometry(root: t.Node) -> None:
    calls = [n for n in root.walk() if isinstance(n, t.Call)]
    for c in calls:
        if c.name in REFUSED:
            raise UnsupportedAdqlError(f"{c.name} is not supported.")
        if c.name in NOT_PROVIDED:
            raise UnsupportedAdqlError(f"{c.name} is not supported.")
    in_predicate = {id(a) for c in calls if c.name in PREDICATES for a in c.args}
    for c in calls:
        if c.name in SHAPES or c.name == "POLYGON":
            _check_shape(c)
        if c.name == "POLYGON" and id(c) not in in_predicate:
            raise UnsupportedAdqlError("POLYGON is only supported as an argument of CONTAINS or INTERSECTS.")
        if c.name in PREDICATES + ("DISTANCE",) and len(c.args) != 2:
            raise UnsupportedAdqlError(f"{c.name} takes two geometry arguments.")
        if c.name == "CONTAINS":
            left, right = map(geometry_kind, c.args)
            if left != "point" or right not in ("circle", "polygon", "region"):
                raise UnsupportedAdqlError(
                    "CONTAINS is only supported between POINT and CIRCLE, POLYGON, or a region column or string."
                )
        if c.name == "INTERSECTS":
            kinds = {geometry_kind(a) for a in c.args}
            if not kinds <= {"circle", "polygon", "region"} or kinds == {"circle"}:
                raise UnsupportedAdqlError(
                    "INTERSECTS is only supported between CIRCLE, POLYGON and region columns or strings, not two CIRCLEs."
                )
        if c.name == "DISTANCE" and any(geometry_kind(a) != "point" for a in c.args):
            raise UnsupportedAdqlError("DISTANCE is only supported between two POINT values.")
        if c.name in ("COORD1", "COORD2", "COORDSYS") and (
            len(c.args) != 1 or geometry_kind(c.args[0]) not in ("point", "circle")
        ):
            raise UnsupportedAdqlError(f"{c.name} requires a POINT or CIRCLE argument.")


def _check_shape(c: t.Call) -> None:
    if not c.args or not isinstance(c.args[0], t.Text):
        raise UnsupportedAdqlError(f"{c.name} requires a literal coordinate system, e.g. 'ICRS'.")
    if c.args[0].value.strip().lower() != "icrs":
        raise UnsupportedAdqlError(f"Coordinate frame '{c.args[0].value}' is not supported; only ICRS is.")
    n = len(c.args) - 1
    if c.name == "POLYGON":
        if n < 6 or n % 2:
            raise AdqlSyntaxError("POLYGON requires an even number of coordinates for at least 3 vertices", c.at)
    elif n != SHAPES[c.name] - 1:
        raise AdqlSyntaxError(f"{c.name} takes a coordinate system and {SHAPES[c.name] - 1} numbers", c.at)
    if c.name == "CIRCLE" and (r := literal_number(c.args[3])) is not None and r < 0:
        raise AdqlSyntaxError(f"CIRCLE radius must not be negative: {r:g}", c.at)


def geometry_kind(node: t.Node) -> str | None:
    if isinstance(node, t.Call):
        return {"POINT": "point", "CIRCLE": "circle", "POLYGON": "polygon"}.get(node.name)
    return "region" if isinstance(node, (t.Column, t.Text)) else None


def literal_cone(call: t.Node) -> ConeHint | None:
    if isinstance(call, t.Call) and call.name == "CONTAINS" and geometry_kind(call.args[1]) == "circle":
        numbers = [literal_number(a) for a in call.args[1].args[1:]]
        if None not in numbers:
            return ConeHint(*numbers)
    return None


def truth_of(node: t.Node) -> tuple[t.Call, bool] | None:
    """``CONTAINS(...) = 1`` and its like: the predicate, and whether it is to hold."""
    if not isinstance(node, t.Binary) or node.op not in ("=", "<>"):
        return None
    for call, other in ((node.left, node.right), (node.right, node.left)):
        if isinstance(call, t.Call) and call.name in PREDICATES:
            if (x := literal_number(other)) in (0.0, 1.0):
                return call, (x == 1) == (node.op == "=")
            if isinstance(other, t.Constant) and other.word in ("TRUE", "FALSE"):
                return call, (other.word == "TRUE") == (node.op == "=")
    return None


def conjuncts(node: t.Node | None) -> list[t.Node]:
    if node is None:
        return []
    if isinstance(node, t.Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


# --- names --------------------------------------------------------------------


@dataclass
class Source:
    """One entry of a FROM clause. ``columns`` is None where unknown."""

    alias: str
    columns: list[str] | None
    table: TableMeta | None = None
    node: t.Node | None = None
    view: str = ""

    @property
    def keys(self) -> set[str]:
        own = {self.alias.lower()}
        return own | ({self.table.qualified.lower()} if self.table else set())

    def has(self, column: str) -> bool:
        return self.columns is None or column.lower() in (c.lower() for c in self.columns)


@dataclass
class Scope:
    sources: list[Source]
    outer: Scope | None = None
    aliases: set[str] = field(default_factory=set)


def close(name: str, known: list[str]) -> list[str]:
    return difflib.get_close_matches(name.lower(), known, n=3)


INNER, OUTER = (",", "INNER", "CROSS"), ("LEFT", "RIGHT", "FULL")
#: A table of fewer bytes a core is read by few tasks.
FEW_BYTES = 16_000_000


@dataclass(frozen=True)
class Match:
    """A join test: ``one``'s position in ``other``'s circle or region, or two regions."""

    one: Source
    other: Source
    position: tuple[str, ...]
    centre: tuple[str, ...]
    radius: float | None = None
    radius_column: str = ""
    regions: tuple[str, ...] = ()
    nodes: tuple[t.Node, ...] = ()
    #: The predicate, where it is about two regions.
    call: t.Call | None = None

    def turned(self) -> Match:
        return Match(self.other, self.one, self.centre, self.position, self.radius)


def _joins(node: t.Node) -> list[t.Join]:
    """The joins of a FROM clause, inner ones of the tree first."""
    return [*_joins(node.left), *_joins(node.right), node] if isinstance(node, t.Join) else []


def _tables(node: t.Node) -> list[t.Node]:
    return [*_tables(node.left), *_tables(node.right)] if isinstance(node, t.Join) else [node]


def _parted(n: t.Join, m: Match) -> bool:
    """Whether a join brings a match's two tables together."""
    left, right = ({id(x) for x in _tables(side)} for side in (n.left, n.right))
    one, other = id(m.one.node), id(m.other.node)
    return one in left and other in right or one in right and other in left


class _Renderer:
    def __init__(self, registry) -> None:
        self.registry = registry
        self.pruned: dict[str, tuple[TableMeta, list[str]]] = {}
        self.hint: ConeHint | None = None
        #: Scopes whose tables have helper columns.
        self.bound: set[int] = set()
        #: Region operands that a join has parsed already.
        self.parsed: dict[int, str] = {}
        #: Predicates that the keys of their join decide.
        self.settled: set[int] = set()
        #: Rendered entries of FROM clauses, and tests that a join or a WHERE clause gets beside its own.
        self.rendered: dict[int, str] = {}
        #: Aliases to shuffle by cell: their tables are read by too few tasks for costly tests.
        self.spread: dict[int, list[str]] = {}
        self.extra: dict[int, list[str]] = {}

    # -- queries ---------------------------------------------------------------
    def query(self, q: t.Node, outer: Scope | None, ctes: dict[str, list[str] | None]) -> tuple[str, list[str] | None]:
        """SQL text and output columns (None: unknown)."""
        ctes = dict(ctes)
        heads = []
        for name, body in q.ctes:
            sql, columns = self.query(body, outer, ctes)
            heads.append(f"{quoted(name)} AS ({sql})")
            ctes[name.lower()] = columns
        head = f"WITH {', '.join(heads)} " if heads else ""
        if isinstance(q, t.SetOperation):
            left, columns = self.query(q.left, outer, ctes)
            right, _ = self.query(q.right, outer, ctes)
            sql = f"({left}) {q.op}{' ALL' if q.all else ''} ({right})"
            scope = Scope([Source("", columns)], outer)
            if q.order or q.limit is not None or q.offset is not None:
                sql = f"SELECT * FROM ({sql})" + self.tail(q, scope)
            return head + sql, columns
        sql, columns = self.select(q, outer, ctes)
        return head + sql, columns

    def tail(self, q, scope: Scope) -> str:
        out = ""
        if q.order:
            out += " ORDER BY " + self.orderings(q.order, scope)
        if q.limit is not None:
            out += f" LIMIT {q.limit}"
        if q.offset is not None:
            out += f" OFFSET {q.offset}"
        return out

    def orderings(self, order: list[t.Ordering], scope: Scope) -> str:
        return ", ".join(f"{self.expr(o.value, scope)} {'DESC' if o.descending else 'ASC'} NULLS LAST" for o in order)

    def select(self, q: t.Select, outer: Scope | None, ctes: dict) -> tuple[str, list[str] | None]:
        scope = Scope([], outer)
        from_sql = ""
        if q.source is not None:
            alone = not isinstance(q.source, t.Join)
            from_sql = " FROM " + self.source(q.source, scope, ctes, self.prunable(q), alone)
            if isinstance(q.source, t.Join) and (joined := self.sky_join(q, scope)):
                from_sql = " FROM " + joined
        items, columns = [], []
        for item in q.items:
            if isinstance(item.value, t.Star):
                text, names = self.star(item.value, scope)
                items.append(text)
                columns = None if names is None or columns is None else columns + names
                continue
            text = self.expr(item.value, scope)
            name = item.alias or (item.value.parts[-1] if isinstance(item.value, t.Column) else None)
            if item.alias:
                text += f" AS {quoted(item.alias)}"
            items.append(text)
            if columns is not None:
                columns.append(name or text)
        hint = f"/*+ MERGE({', '.join(self.spread[id(scope)])}) */ " if id(scope) in self.spread else ""
        sql = f"SELECT {hint}" + ("DISTINCT " if q.distinct else "") + ", ".join(items) + from_sql
        tests = ([self.expr(q.where, scope)] if q.where is not None else []) + self.extra.get(id(scope), [])
        if tests:
            sql += " WHERE " + " AND ".join(tests)
        scope.aliases = {i.alias.lower() for i in q.items if i.alias}
        if q.groups is not None:
            sets = [", ".join(self.expr(x, scope) for x in s) for s in q.groups.sets]
            if q.groups.kind == "SETS":
                sql += " GROUP BY GROUPING SETS (" + ", ".join(f"({s})" for s in sets) + ")"
            else:
                sql += f" GROUP BY {q.groups.kind}({sets[0]})" if q.groups.kind else f" GROUP BY {sets[0]}"
        if q.having is not None:
            sql += " HAVING " + self.expr(q.having, scope)
        return sql + self.tail(q, scope), columns

    def star(self, star: t.Star, scope: Scope) -> tuple[str, list[str] | None]:
        sources = scope.sources
        if star.qualifier:
            found = [s for s in sources if ".".join(star.qualifier).lower() in s.keys]
            if not found:
                raise UnknownTableError(".".join(star.qualifier), close(star.qualifier[-1], [s.alias for s in sources]))
            sources = found[:1]
        known = None if any(s.columns is None for s in sources) else [c for s in sources for c in s.columns]
        if id(scope) in self.bound:  # a cell join has helper columns: name the others
            return ", ".join(f"{quoted(s.alias)}.{quoted(c)}" for s in sources for c in s.columns), known
        return (f"{quoted(sources[0].alias)}.*" if star.qualifier else "*"), known

    # -- sources ---------------------------------------------------------------
    def source(self, node: t.Node, scope: Scope, ctes: dict, cones: list = (), alone: bool = True) -> str:
        if isinstance(node, t.Derived):
            inner = Scope([], scope.outer)
            sql, columns = self.query(node.query, inner.outer, ctes)
            alias = node.alias or f"q{len(scope.sources)}"
            scope.sources.append(Source(alias, columns, None, node))
            self.rendered[id(node)] = f"({sql}) AS {quoted(alias)}"
            return self.rendered[id(node)]
        if isinstance(node, t.Join):
            self.source(node.left, scope, ctes, cones, alone)
            self.source(node.right, scope, ctes, cones, alone)
            return self.tree(node, scope)
        name = ".".join(node.parts)
        if len(node.parts) == 1 and name.lower() in ctes:
            alias = node.alias or name
            scope.sources.append(Source(alias, ctes[name.lower()], None, node))
            self.rendered[id(node)] = f"{quoted(name)} AS {quoted(alias)}"
            return self.rendered[id(node)]
        table = self.registry.find(name) if len(node.parts) <= 2 else None
        if table is None:
            raise UnknownTableError(name, close(name, self.registry.names()))
        alias = node.alias or node.parts[-1]
        scope.sources.append(Source(alias, [c.name for c in table.columns], table, node))
        view = quoted(table.view)
        if table.shards:
            kept = list(table.shards)
            for call, cone in cones:
                if self.on_position(call, table, scope.sources[-1], alone):
                    kept = shards.kept(kept, cone.ra0, cone.dec0, cone.radius_deg)
            if len(kept) < len(table.shards):
                view = f"{table.view}__pruned_{len(self.pruned)}"
                self.pruned[view] = (table, [s.path for s in kept])
                view = quoted(view)
        scope.sources[-1].view = view
        self.rendered[id(node)] = f"{view} AS {quoted(alias)}"
        return self.rendered[id(node)]

    def tree(self, node: t.Node, scope: Scope) -> str:
        """A FROM clause whose entries are rendered."""
        if not isinstance(node, t.Join):
            return self.rendered[id(node)]
        left, right = self.tree(node.left, scope), self.tree(node.right, scope)
        right = f"({right})" if isinstance(node.right, t.Join) else right
        if node.kind == ",":
            return f"{left}, {right}"
        natural = "NATURAL " if node.natural else ""
        sql = f"{left} {natural}{node.kind} JOIN {right}"
        if node.on is not None:
            sql += " ON " + " AND ".join([self.expr(node.on, scope), *self.extra.get(id(node), [])])
        elif node.using:
            sql += " USING (" + ", ".join(map(quoted, node.using)) + ")"
        return sql

    @staticmethod
    def prunable(q: t.Select) -> list[tuple[t.Call, ConeHint]]:
        """The literal cones that every row must meet: positive conjuncts of
        WHERE. In a join, whatever its kind, a row without its part of the table
        that a cone is about meets none."""
        found = []
        for c in conjuncts(q.where):
            truth = truth_of(c)
            call, holds = truth if truth else (c, True)
            if holds and (cone := literal_cone(call)) and 0 <= cone.radius_deg < 180:
                found.append((call, cone))
        return found

    @staticmethod
    def on_position(call: t.Call, table: TableMeta, source: Source, alone: bool) -> bool:
        """Whether a cone is about a table's position; in a join only by a name that says so."""
        point = call.args[0].args[1:]
        wanted = (table.ra_column, table.dec_column)
        return all(
            isinstance(p, t.Column)
            and w
            and p.parts[-1].lower() == w.lower()
            and (alone if len(p.parts) == 1 else ".".join(p.parts[:-1]).lower() in source.keys)
            for p, w in zip(point, wanted, strict=True)
        )

    # -- joins by distance or region -----------------------------------------------
    def sky_join(self, q: t.Select, scope: Scope) -> str | None:
        """The FROM clause with sky cells as equi-keys of its joins by distance
        or region, or None where it has none that cells help."""
        nodes = [n for n in _joins(q.source)]
        if any(n.natural or n.using for n in nodes) and any(isinstance(i.value, t.Star) for i in q.items):
            return None  # merged columns that helper columns would show beside
        if any(isinstance(i.value, t.Star) for i in q.items) and any(s.columns is None for s in scope.sources):
            return None
        inner = all(n.kind in INNER and not n.natural for n in nodes)
        found: list[tuple[t.Join, Match, bool]] = []  # where, what, whether WHERE has it
        for c in conjuncts(q.where) if inner else []:
            if m := self.match(c, scope):
                found.append((next(n for n in nodes if _parted(n, m)), m, True))
        for n in nodes:
            for c in conjuncts(n.on):
                if (m := self.match(c, scope)) and _parted(n, m):
                    found.append((n, m, False))
        if len(nodes) == 1 and nodes[0].kind in OUTER:
            for n, m, _ in found:
                if not (m.radius is not None and n.kind in ("LEFT", "RIGHT")):
                    return self.outer(n, m, scope)
        helpers: dict[int, list[tuple[str, str]]] = defaultdict(list)  # table -> (kind, SQL of a column or a table)
        copied: set[int] = set()
        done: set[frozenset[int]] = set()
        for n, m, from_where in found:
            pair = frozenset(map(id, (m.one, m.other)))
            if pair in done or n.natural or n.using:
                continue
            if m.radius is not None and (n.kind in ("LEFT", "RIGHT") or id(m.other) in copied):
                # A circle and a point of the same distance may change places: the copied side may be missing.
                missing = {id(x) for x in _tables(n.right if n.kind == "LEFT" else n.left)}
                if n.kind in ("LEFT", "RIGHT") and id(m.other.node) not in missing or n.kind in INNER:
                    m = m.turned()
            if n.kind in OUTER and (m.radius is None or n.kind == "FULL"):
                continue  # only two tables can be joined so (see outer)
            if id(m.other) in copied or m.one.view == "" or m.other.view == "":
                continue
            k = len(done)
            done.add(pair)
            copied.add(id(m.other))
            known = [c for x in nodes if inner or x is n for c in conjuncts(x.on)] + (conjuncts(q.where) if inner else [])
            narrow = self.narrow(m, known, scope)
            on = self.keyed(m, k, helpers, quoted(m.one.alias), quoted(m.other.alias), narrow=narrow)
            if m.regions:
                copied.add(id(m.one))
                if all(self.few_tasks(x.view) for x in (m.one, m.other)):
                    self.spread.setdefault(id(scope), []).append(quoted(m.other.alias))
            self.extra.setdefault(id(scope) if from_where else id(n), []).extend(on)
            if not from_where and n.on is None:
                self.extra.setdefault(id(scope), []).extend(on)
        if not done:
            return None
        self.bound.add(id(scope))
        for s in scope.sources:
            if id(s) in helpers:
                source = self.parsing(s.view) if any(k == "parsed" for k, _ in helpers[id(s)]) else s.view
                self.rendered[id(s.node)] = f"({self.helped(source, helpers[id(s)])}) AS {quoted(s.alias)}"
        return self.tree(q.source, scope)

    def few_tasks(self, view: str) -> bool:
        """Whether a table is so small that its scan has fewer tasks than there are cores."""
        spark = getattr(self.registry, "spark", None)
        if spark is None or view.strip("`") in self.pruned:
            return False
        size = spark.table(view)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size)) < FEW_BYTES * spark.sparkContext.defaultParallelism

    def parsing(self, view: str) -> str:
        """A table whose regions are to be parsed, by as many tasks as there are cores."""
        if not self.few_tasks(view):
            return view
        return f"(SELECT /*+ REPARTITION({self.registry.spark.sparkContext.defaultParallelism}) */ * FROM {view})"

    def texts(self, source: Source, region: str, tests: list[str]) -> str:
        """The distinct region texts of a table's rows that pass some tests, dealt
        over as many tasks as there are cores."""
        where = " AND ".join([f"{region} IS NOT NULL", *tests])
        sql = f"SELECT DISTINCT {region} AS {cells.TEXT} FROM {source.view} AS {quoted(source.alias)} WHERE {where}"
        spark = getattr(self.registry, "spark", None)
        if spark is None:
            return f"({sql})"
        n = spark.sparkContext.defaultParallelism
        if not self.few_tasks(source.view):
            n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return f"(SELECT /*+ REPARTITION({n}) */ * FROM ({sql}))"

    def narrow(self, m: Match, known: list[t.Node], scope: Scope) -> dict[int, list[str]] | None:
        """For two regions: the tests that each table's rows have to pass alone.
        None where the rows themselves are to be put into cells, as some of the
        conjuncts equates columns of the two tables: that leaves fewer pairs."""
        if m.call is None:
            return None
        for c in known:
            if isinstance(c, t.Binary) and c.op == "=" and isinstance(c.left, t.Column) and isinstance(c.right, t.Column):
                if {id(self.owner(x, scope)) for x in (c.left, c.right)} == {id(m.one), id(m.other)}:
                    return None
        return {id(x): self.own_tests(x, known, scope) for x in (m.one, m.other)}

    def own_tests(self, source: Source, known: list[t.Node], scope: Scope) -> list[str]:
        """Those of some conjuncts that a table's row alone decides."""
        out = []
        for c in known:
            nodes = list(c.walk())
            names = [x for x in nodes if isinstance(x, t.Column)]
            plain = not any(isinstance(x, (t.Select, t.SetOperation)) or isinstance(x, t.Call) and x.name == "RAND" for x in nodes)
            if plain and names and all(self.owner(x, scope) is source for x in names):
                out.append(self.expr(c, scope))
        return out

    @staticmethod
    def helped(source: str, helpers: list[tuple[str, str]]) -> str:
        """SQL of a table with helper columns: parsed regions, then cells, then
        copies, then copies for the regions that a region meets."""
        sql = source
        for kind in ("parsed", "plain", "copies", "met"):
            for _, text in (h for h in helpers if h[0] == kind):
                sql = text.replace("{source}", sql) if kind in ("parsed", "met") else f"SELECT *, {text} FROM {sql}"
                sql = f"({sql})"
        return sql.removeprefix("(").removesuffix(")") if sql != source else f"SELECT * FROM {source}"

    def keyed(
        self, m: Match, k: int, helpers: dict, one: str, other: str, rows: tuple[str, str] = ("", ""), narrow: dict | None = None
    ) -> list[str]:
        """Puts the helper columns of a match into ``helpers``; the tests that
        join them. ``rows``: struct columns that hold the tables' own columns.
        ``narrow``: see there; with it regions meet as texts."""
        cell = f"{cells.CELL}_{k}"
        first, second = helpers[id(m.one)], helpers[id(m.other)]
        equal = f"{one}.{cell} = {other}.{cell}"
        at = [f"{rows[0]}{c}" for c in m.position]
        around = [f"{rows[1]}{c}" for c in m.centre]
        if m.radius is not None:
            first.append(("plain", f"{cells.point_cell(*at, m.radius)} AS {cell}"))
            second.append(("copies", f"explode_outer({cells.circle_cells(*around, m.radius)}) AS {cell}"))
            return [equal]
        levels = f"{cells.LEVELS}_{k}"
        if m.radius_column:
            first.append(("plain", f"{cells.levels_of_circles(m.other.view, m.radius_column)} AS {levels}"))
            first.append(("copies", f"explode_outer({cells.point_keys(*at, levels)}) AS {cell}"))
            second.append(("copies", f"explode_outer({cells.circle_keys(*around, f'{rows[1]}{m.radius_column}')}) AS {cell}"))
            return [equal]
        if narrow is not None:
            texts = [self.texts(x, r, narrow[id(x)]) for x, r in zip((m.one, m.other), m.regions, strict=True)]
            spread = all(self.few_tasks(x.view) for x in (m.one, m.other))
            first.append(("met", cells.met(f"{rows[0]}{m.regions[0]}", cells.meeting(*texts, spread), cell, spread)))
            self.settled.add(id(m.call))
            return [f"{one}.{cell} = {other}.{rows[1]}{m.regions[1]}"]
        sky = f"__sky_{k}"
        second.append(("parsed", cells.parsed_once("{source}", f"{rows[1]}{m.regions[-1]}", f"{sky}_b")))
        second.append(("plain", f"{sky}_b.g AS {cells.REGION}_{k}_b"))
        self.parsed[id(m.nodes[-1])] = f"{other}.{cells.REGION}_{k}_b"
        if len(m.regions) == 1:
            first.append(("plain", f"{cells.levels_of_regions(self.parsing(m.other.view), m.regions[0])} AS {levels}"))
            first.append(("copies", f"explode_outer({cells.point_keys(*at, levels)}) AS {cell}"))
            second.append(("copies", f"explode_outer({cells.region_keys(f'{sky}_b')}) AS {cell}"))
            return [equal]
        first.append(("parsed", cells.parsed_once("{source}", f"{rows[0]}{m.regions[0]}", f"{sky}_a")))
        first.append(("plain", f"{sky}_a.g AS {cells.REGION}_{k}_a"))
        self.parsed[id(m.nodes[0])] = f"{one}.{cells.REGION}_{k}_a"
        tests = []
        for side, s, there in ((first, f"{sky}_a", (m.other, m.regions[1])), (second, f"{sky}_b", (m.one, m.regions[0]))):
            tag = s[-1]
            side.append(("plain", f"{cells.levels_of_regions(self.parsing(there[0].view), there[1])} AS {levels}_{tag}"))
            side.append(("plain", f"{s}.c AS {cells.CAP}_{k}_{tag}"))
            side.append(("plain", f"{cells.region_cells(s, f'{levels}_{tag}')} AS {cells.CELLS}_{k}_{tag}"))
            side.append(("copies", f"explode_outer({cells.dealt_cells(f'{cells.CELLS}_{k}_{tag}', s)}) AS {cell}"))
        caps = f"{one}.{cells.CAP}_{k}_a", f"{other}.{cells.CAP}_{k}_b"
        apart = sphere.hav(f"{caps[0]}.ra", f"{caps[0]}.dec", f"{caps[1]}.ra", f"{caps[1]}.dec")
        tests = [f"{one}.{cell}.key = {other}.{cell}.key", f"{apart} <= {caps[0]}.radius + {caps[1]}.radius"]
        tests.append(cells.first_meeting(f"{one}.{cell}", f"{other}.{cell}", f"{one}.{cells.CELLS}_{k}_a", f"{other}.{cells.CELLS}_{k}_b"))
        return tests

    def outer(self, n: t.Join, m: Match, scope: Scope) -> str | None:
        """Two tables in an outer join both of whose rows may have copies."""
        left, right = scope.sources
        if not left.view or not right.view or n.on is None or n.natural:
            return None
        self.bound.add(id(scope))
        helpers: dict[int, list[tuple[str, str]]] = defaultdict(list)
        names = {id(left): quoted(left.alias), id(right): quoted(right.alias)}
        sides = {id(left): "__l", id(right): "__r"}
        rows = (f"{names[id(m.one)]}.", f"{names[id(m.other)]}.")
        on = self.keyed(m, 0, helpers, sides[id(m.one)], sides[id(m.other)], rows, self.narrow(m, conjuncts(n.on), scope))
        both = [self.helped(cells.numbered(s.view, names[id(s)]), helpers[id(s)]) for s in (left, right)]
        tests = " AND ".join([*on, self.expr(n.on, scope)])
        return f"({cells.whole_outer(*both, names[id(left)], names[id(right)], n.kind, tests)}) AS __pairs"

    def match(self, c: t.Node, scope: Scope) -> Match | None:
        """What a conjunct says of two tables' positions, circles or regions."""
        truth = truth_of(c)
        call, holds = truth if truth else (c, True)
        if isinstance(call, t.Call) and call.name in PREDICATES and holds:
            kinds = [geometry_kind(a) for a in call.args]
            if kinds == ["point", "circle"]:
                return self.circles(call.args[0].args[1:], call.args[1].args[1:3], call.args[1].args[3], scope)
            if kinds in (["point", "region"], ["region", "region"]):
                return self.regions(call, kinds, scope)
            return None
        if isinstance(c, t.Binary) and c.op in ("<", "<=", ">", ">="):
            near, far = (c.left, c.right) if c.op[0] == "<" else (c.right, c.left)
            if isinstance(near, t.Call) and near.name == "DISTANCE":
                return self.circles(near.args[0].args[1:], near.args[1].args[1:], far, scope)
        return None

    def circles(self, point: list, centre: list, radius: t.Node, scope: Scope) -> Match | None:
        owners = [self.one_owner(x, scope) for x in (point, centre)]
        if None in owners or owners[0] is owners[1]:
            return None
        names = [tuple(quoted(x.parts[-1]) for x in xs) for xs in (point, centre)]
        if (value := literal_number(radius)) is not None:
            return Match(*owners, names[0], names[1], value) if 0 < value <= 180 else None
        owner = self.one_owner([radius], scope)
        if owner is owners[0]:
            owners, names = owners[::-1], names[::-1]
        elif owner is not owners[1]:
            return None
        return Match(*owners, names[0], names[1], None, quoted(radius.parts[-1]))

    def regions(self, call: t.Call, kinds: list, scope: Scope) -> Match | None:
        sides = [a.args[1:] if k == "point" else [a] for a, k in zip(call.args, kinds, strict=True)]
        owners = [self.one_owner(x, scope) for x in sides]
        if None in owners or owners[0] is owners[1]:
            return None
        regions = [(quoted(x[0].parts[-1]), a) for x, a, k in zip(sides, call.args, kinds, strict=True) if k == "region"]
        position = tuple(quoted(x.parts[-1]) for x in sides[0]) if kinds[0] == "point" else ()
        both = call if len(regions) == 2 else None
        return Match(*owners, position, (), None, "", tuple(r for r, _ in regions), tuple(a for _, a in regions), both)

    def one_owner(self, columns: list, scope: Scope) -> Source | None:
        """The table that all of the columns are of."""
        if not all(isinstance(c, t.Column) for c in columns):
            return None
        owners = [self.owner(c, scope) for c in columns]
        return owners[0] if owners[0] is not None and all(o is owners[0] for o in owners) else None

    @staticmethod
    def owner(c: t.Column, scope: Scope) -> Source | None:
        if len(c.parts) > 1:
            found = [s for s in scope.sources if ".".join(c.parts[:-1]).lower() in s.keys]
        else:
            found = [s for s in scope.sources if s.has(c.parts[0])]
        return found[0] if len(found) == 1 else None

    # -- columns ---------------------------------------------------------------
    def column(self, c: t.Column, scope: Scope) -> str:
        name, level = c.parts[-1], scope
        if len(c.parts) > 1:
            key = ".".join(c.parts[:-1]).lower()
            while level is not None:
                for s in level.sources:
                    if key in s.keys:
                        if not s.has(name):
                            where = s.table.qualified if s.table else s.alias
                            raise UnknownColumnError(name, where, close(name, [x.lower() for x in s.columns]))
                        return f"{quoted(s.alias)}.{quoted(name)}"
                level = level.outer
            raise UnknownTableError(".".join(c.parts[:-1]), close(key, [k for s in scope.sources for k in s.keys]))
        known: list[str] = []
        while level is not None:
            if name.lower() in level.aliases:
                return quoted(name)
            for s in level.sources:
                if s.has(name):
                    if id(level) in self.bound and self.owner(c, level) is s:
                        return f"{quoted(s.alias)}.{quoted(name)}"
                    return quoted(name)
                known += [x.lower() for x in s.columns or []]
            level = level.outer
        if not scope.sources and scope.outer is None:
            raise UnknownColumnError(name, None, [])
        only = scope.sources[0].table if len(scope.sources) == 1 else None
        raise UnknownColumnError(name, only.qualified if only else None, close(name, known))

    # -- expressions -------------------------------------------------------------
    def expr(self, n: t.Node, scope: Scope) -> str:
        return getattr(self, "_" + type(n).__name__.lower())(n, scope)

    def _number(self, n: t.Number, scope: Scope) -> str:
        if n.text.isdigit():
            return n.text if len(n.text) < 19 else f"{n.text}D"
        return f"{float(n.text)!r}D"

    def _text(self, n: t.Text, scope: Scope) -> str:
        return text_literal(n.value)

    def _constant(self, n: t.Constant, scope: Scope) -> str:
        return n.word

    def _column(self, n: t.Column, scope: Scope) -> str:
        return self.column(n, scope)

    def _star(self, n: t.Star, scope: Scope) -> str:
        raise AdqlSyntaxError("'*' is not an expression")

    def _unary(self, n: t.Unary, scope: Scope) -> str:
        return f"(NOT {self.expr(n.value, scope)})" if n.op == "NOT" else f"({n.op}{self.expr(n.value, scope)})"

    def _binary(self, n: t.Binary, scope: Scope) -> str:
        if truth := truth_of(n):
            sql = self.expr(truth[0], scope)
            return sql if truth[1] else f"(NOT {sql})"
        left, right = self.expr(n.left, scope), self.expr(n.right, scope)
        if n.op == "/":
            x = literal_number(n.right)
            if x:
                return f"({left} / {right})"
            return f"(CASE WHEN {right} = 0 THEN {left} * CAST('Infinity' AS DOUBLE) ELSE try_divide({left}, {right}) END)"
        if n.op == "%":
            return f"try_mod({left}, {right})"
        return f"({left} {n.op} {right})"

    def _between(self, n: t.Between, scope: Scope) -> str:
        word = "NOT BETWEEN" if n.negated else "BETWEEN"
        return f"({self.expr(n.value, scope)} {word} {self.expr(n.low, scope)} AND {self.expr(n.high, scope)})"

    def _in(self, n: t.In, scope: Scope) -> str:
        if isinstance(n.items[0], t.Subquery):
            items, _ = self.query(n.items[0].query, scope, self.ctes)
        else:
            items = ", ".join(self.expr(i, scope) for i in n.items)
        return f"({self.expr(n.value, scope)} {'NOT IN' if n.negated else 'IN'} ({items}))"

    def _like(self, n: t.Like, scope: Scope) -> str:
        word = ("NOT " if n.negated else "") + ("ILIKE" if n.any_case else "LIKE")
        # No pattern escapes: a character that text does not hold stands for the escape.
        return f"({self.expr(n.value, scope)} {word} {self.expr(n.pattern, scope)} ESCAPE '\\u0001')"

    def _isnull(self, n: t.IsNull, scope: Scope) -> str:
        return f"({self.expr(n.value, scope)} IS {'NOT ' if n.negated else ''}NULL)"

    def _exists(self, n: t.Exists, scope: Scope) -> str:
        return f"EXISTS ({self.query(n.query, scope, self.ctes)[0]})"

    def _subquery(self, n: t.Subquery, scope: Scope) -> str:
        return f"({self.query(n.query, scope, self.ctes)[0]})"

    def _case(self, n: t.Case, scope: Scope) -> str:
        base = f" {self.expr(n.base, scope)}" if n.base is not None else ""
        whens = "".join(f" WHEN {self.expr(a, scope)} THEN {self.expr(b, scope)}" for a, b in n.whens)
        default = f" ELSE {self.expr(n.default, scope)}" if n.default is not None else ""
        return f"CASE{base}{whens}{default} END"

    def _cast(self, n: t.Cast, scope: Scope) -> str:
        return f"CAST({self.expr(n.value, scope)} AS {n.type})"

    def _call(self, n: t.Call, scope: Scope) -> str:
        special = getattr(self, "_fn_" + n.name.lower(), None)
        if special:
            return special(n, scope)
        if n.over is not None and n.name in WINDOWS | AGGREGATES:
            sql = f"{self.plain(n, (WINDOWS | AGGREGATES)[n.name], scope)} OVER ({self.over(n.over, scope)})"
            return f"CAST({sql} AS BIGINT)" if n.name in COUNTING else sql
        if n.name in AGGREGATES:
            return self.plain(n, AGGREGATES[n.name], scope)
        if n.name in SCALARS and n.over is None:
            return self.plain(n, SCALARS[n.name], scope)
        if n.name in WINDOWS:
            raise UnsupportedAdqlError(f"{n.name} requires an OVER clause.")
        raise UnsupportedAdqlError(f"Function {n.name} is not supported.")

    def plain(self, n: t.Call, name: str, scope: Scope) -> str:
        if n.args and isinstance(n.args[0], t.Star):
            if n.name != "COUNT":
                raise AdqlSyntaxError(f"{n.name}(*) is not valid", n.at)
            return "count(*)"
        args = ", ".join(self.expr(a, scope) for a in n.args)
        return f"{name}({'DISTINCT ' if n.distinct else ''}{args})"

    def over(self, o: t.Over, scope: Scope) -> str:
        parts = []
        if o.partition:
            parts.append("PARTITION BY " + ", ".join(self.expr(x, scope) for x in o.partition))
        if o.order:
            parts.append("ORDER BY " + self.orderings(o.order, scope))
        if o.frame:
            parts.append(o.frame)
        return " ".join(parts)

    def _fn_round(self, n: t.Call, scope: Scope) -> str:
        return f"round({', '.join(self.expr(a, scope) for a in n.args)})"

    def _fn_ceiling(self, n: t.Call, scope: Scope) -> str:
        return f"CAST(ceil({self.expr(self.one(n), scope)}) AS DOUBLE)"

    _fn_ceil = _fn_ceiling

    def _fn_floor(self, n: t.Call, scope: Scope) -> str:
        return f"CAST(floor({self.expr(self.one(n), scope)}) AS DOUBLE)"

    def _fn_truncate(self, n: t.Call, scope: Scope) -> str:
        if len(n.args) not in (1, 2):
            raise AdqlSyntaxError("TRUNCATE takes one or two arguments", n.at)
        x = self.expr(n.args[0], scope)
        if len(n.args) == 1:
            return f"(sign({x}) * floor(abs({x})))"
        scale = f"power(10D, {self.expr(n.args[1], scope)})"
        return f"(sign({x}) * floor(abs({x}) * {scale}) / {scale})"

    @staticmethod
    def one(n: t.Call) -> t.Node:
        if len(n.args) != 1:
            raise AdqlSyntaxError(f"{n.name} takes one argument", n.at)
        return n.args[0]

    # -- geometry ----------------------------------------------------------------
    def coords(self, shape: t.Call, scope: Scope) -> list[str]:
        return [self.expr(a, scope) for a in shape.args[1:]]

    def vertices(self, node: t.Node, scope: Scope) -> str:
        if isinstance(node, t.Call):
            known = [literal_number(a) for a in node.args[1:]]
            if None not in known:
                return sphere.literal_polygon(list(zip(known[0::2], known[1::2], strict=True)))
            xs = self.coords(node, scope)
            return sphere.polygon(xs[0::2], xs[1::2])
        return self.parsed.get(id(node)) or sphere.parse_region(self.expr(node, scope))

    def _fn_point(self, n: t.Call, scope: Scope) -> str:
        ra, dec = self.coords(n, scope)
        return f"named_struct('ra', CAST({ra} AS DOUBLE), 'dec', CAST({dec} AS DOUBLE))"

    def _fn_circle(self, n: t.Call, scope: Scope) -> str:
        ra, dec, radius = self.coords(n, scope)
        return (
            f"named_struct('ra', CAST({ra} AS DOUBLE), 'dec', CAST({dec} AS DOUBLE),"
            f" 'radius', CAST({radius} AS DOUBLE))"
        )

    def _fn_distance(self, n: t.Call, scope: Scope) -> str:
        return sphere.hav(*self.coords(n.args[0], scope), *self.coords(n.args[1], scope))

    def _fn_coord1(self, n: t.Call, scope: Scope) -> str:
        return self.coords(n.args[0], scope)[0]

    def _fn_coord2(self, n: t.Call, scope: Scope) -> str:
        return self.coords(n.args[0], scope)[1]

    def _fn_coordsys(self, n: t.Call, scope: Scope) -> str:
        return "'ICRS'"

    def _fn_contains(self, n: t.Call, scope: Scope) -> str:
        ra, dec = self.coords(n.args[0], scope)
        other = n.args[1]
        if geometry_kind(other) == "circle":
            if cone := literal_cone(n):
                return sphere.cone_literal(ra, dec, cone.ra0, cone.dec0, cone.radius_deg)
            return sphere.cone(ra, dec, *self.coords(other, scope))
        inside = sphere.point_in_polygon(ra, dec, self.vertices(other, scope))
        cap = self.literal_cap(other)
        if cap and cap[2] < 180:  # pure narrowing, and it reaches the scan
            return f"({sphere.cone_literal(ra, dec, *cap)} AND {inside})"
        return inside

    def literal_cap(self, node: t.Node) -> tuple[float, float, float] | None:
        if not isinstance(node, t.Call) or node.name != "POLYGON":
            return None
        xs = [literal_number(a) for a in node.args[1:]]
        if any(x is None for x in xs):
            return None
        return sphere.bounding_cap(list(zip(xs[0::2], xs[1::2], strict=True)))

    def _fn_intersects(self, n: t.Call, scope: Scope) -> str:
        if id(n) in self.settled:
            return "true"
        a, b = n.args
        if geometry_kind(b) == "circle":
            a, b = b, a
        if geometry_kind(a) == "circle":
            return sphere.circle_meets_polygon(*self.coords(a, scope), self.vertices(b, scope))
        return sphere.polygons_meet(self.vertices(a, scope), self.vertices(b, scope))

    ctes: dict = {}


class Renderer(_Renderer):
    """Keeps the WITH names that subqueries inside expressions see."""

    def query(self, q, outer, ctes):
        before, self.ctes = self.ctes, dict(ctes)
        try:
            for name, body in q.ctes:
                self.ctes.setdefault(name.lower(), None)
            return super().query(q, outer, ctes)
        finally:
            self.ctes = before

    def select(self, q, outer, ctes):
        before, self.ctes = self.ctes, ctes
        try:
            return super().select(q, outer, ctes)
        finally:
            self.ctes = before


def translate(adql: str, registry, set_operations: bool = False) -> Translation:
    """Parses, checks and renders one query over the registry's tables."""
    root = parse(adql, set_operations)
    check_geometry(root)
    hint = next(filter(None, (literal_cone(n) for n in root.walk())), None)
    renderer = Renderer(registry)
    sql, _ = renderer.query(root, None, {})
    return Translation(sql, hint, renderer.pruned)
