"""Syntax trees of statements, and how expressions are printed."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """An expression. str() prints it as result columns are named: operands in parentheses."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object  # bool, int, float, str or None

    def __str__(self):
        if self.value is None:
            return "null"
        if isinstance(self.value, bool):
            return str(self.value).lower()
        return f"'{self.value}'" if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Variable(Expr):
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Parameter(Expr):
    name: str

    def __str__(self):
        return f"${self.name}"


@dataclass(frozen=True)
class Property(Expr):
    base: Expr
    key: str

    def __str__(self):
        return f"{self.base}.{self.key}"


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]

    def __str__(self):
        return f"[{', '.join(map(str, self.items))}]"


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]

    def __str__(self):
        return "{" + ", ".join(f"{k}: {v}" for k, v in self.items) + "}"


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    at: Expr

    def __str__(self):
        return f"{self.base}[{self.at}]"


@dataclass(frozen=True)
class Slice(Expr):
    base: Expr
    start: Expr | None
    end: Expr | None

    def __str__(self):
        return f"{self.base}[{'' if self.start is None else self.start}..{'' if self.end is None else self.end}]"


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # "+", "-", "NOT"
    operand: Expr

    def __str__(self):
        return f"{self.op} ({self.operand})" if self.op == "NOT" else f"{self.op}({self.operand})"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self):
        return f"({self.left}) {self.op} ({self.right})"


@dataclass(frozen=True)
class IsNull(Expr):
    operand: Expr
    negated: bool

    def __str__(self):
        return f"({self.operand}) IS {'NOT ' if self.negated else ''}NULL"


@dataclass(frozen=True)
class HasLabel(Expr):
    operand: Expr
    labels: LabelExpr

    def __str__(self):
        return f"{self.operand}:{self.labels}"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False

    def __str__(self):
        inside = "*" if self.star else ", ".join(map(str, self.args))
        return f"{self.name}({'DISTINCT ' if self.distinct else ''}{inside})"


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None

    def __str__(self):
        head = "" if self.operand is None else f" {self.operand}"
        arms = "".join(f" WHEN {c} THEN {v}" for c, v in self.branches)
        return f"CASE{head}{arms}{'' if self.otherwise is None else f' ELSE {self.otherwise}'} END"


@dataclass(frozen=True)
class LabelExpr:
    """A label or type name, or names joined by `&` (all) or `|` (any)."""

    op: str  # "name", "&", "|"
    name: str = ""
    parts: tuple[LabelExpr, ...] = ()

    def holds(self, labels) -> bool:
        if self.op == "name":
            return self.name in labels
        return (all if self.op == "&" else any)(p.holds(labels) for p in self.parts)

    def names(self) -> list[str]:
        return [self.name] if self.op == "name" else [n for p in self.parts for n in p.names()]

    def __str__(self):
        return self.name if self.op == "name" else self.op.join(map(str, self.parts))


@dataclass(frozen=True)
class NodePattern:
    variable: str | None
    labels: LabelExpr | None
    properties: MapOf | None
    where: Expr | None = None

    def __str__(self):
        label = f":{self.labels}" if self.labels else ""
        return f"({self.variable or ''}{label}{self.properties or ''})"


OUT, IN, BOTH = "out", "in", "both"


@dataclass(frozen=True)
class RelPattern:
    variable: str | None
    types: LabelExpr | None
    direction: str
    #: None for a single relationship, else (least, most); most is None if there is no bound.
    length: tuple[int, int | None] | None
    properties: MapOf | None
    where: Expr | None = None

    def __str__(self):
        label = f":{self.types}" if self.types else ""
        span = ""
        if self.length is not None:
            low, high = self.length
            span = "*" if (low, high) == (1, None) else f"*{low}..{'' if high is None else high}"
        left, right = {OUT: ("-", "->"), IN: ("<-", "-"), BOTH: ("-", "-")}[self.direction]
        return f"{left}[{self.variable or ''}{label}{span}{self.properties or ''}]{right}"


@dataclass(frozen=True)
class Chain:
    """nodes[0] rels[0] nodes[1] rels[1] ... ; a quantified part stands as a rel of its own kind."""

    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern | Quantified, ...]

    def __str__(self):
        text = str(self.nodes[0])
        for rel, node in zip(self.rels, self.nodes[1:], strict=True):
            text += f" {rel} {node}" if isinstance(rel, Quantified) else f"{rel}{node}"
        return text


@dataclass(frozen=True)
class Quantified:
    """A chain repeated low to high times (high None: no bound), each time where `where` holds."""

    chain: Chain
    where: Expr | None
    low: int
    high: int | None

    def __str__(self):
        inside = f"{self.chain}{f' WHERE {self.where}' if self.where else ''}"
        return f"({inside}){{{self.low},{'' if self.high is None else self.high}}}"


@dataclass(frozen=True)
class PatternPart:
    variable: str | None
    #: ("all",), ("any", k), ("shortest", k), ("groups", k) or ("all shortest",)
    selector: tuple
    chain: Chain

    def __str__(self):
        name = f"{self.variable} = " if self.variable else ""
        kinds = {"any": "ANY {} PATHS ", "shortest": "SHORTEST {} PATHS ", "groups": "SHORTEST {} PATH GROUPS ", "all shortest": "ALL SHORTEST PATHS ", "all": ""}
        return name + kinds[self.selector[0]].format(*self.selector[1:]) + str(self.chain)


@dataclass
class Item:
    expr: Expr
    alias: str | None


@dataclass
class Projection:
    """The body of WITH or RETURN."""

    star: bool
    items: list[Item]
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # (expression, descending)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False


@dataclass
class Match:
    parts: list[PatternPart]
    where: Expr | None
    optional: bool
    mode: str  # "trail" or "walk"


@dataclass
class Create:
    parts: list[PatternPart]


@dataclass
class Unwind:
    expr: Expr
    variable: str


@dataclass
class Load:
    format: str
    source: str
    options: dict[str, object]
    variable: str


@dataclass
class SingleQuery:
    clauses: list


@dataclass
class Query:
    parts: list[SingleQuery]
    all: bool  # UNION ALL


@dataclass
class CreateConstraint:
    name: str
    if_not_exists: bool
    entity: str  # "node" or "rel"
    label: str
    variable: str
    kind: str  # "unique", "node key", "not null"
    properties: tuple[str, ...]


@dataclass
class DropConstraint:
    name: str
    if_exists: bool
