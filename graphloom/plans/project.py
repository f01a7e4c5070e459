"""WITH and RETURN: projection, aggregation, DISTINCT, ORDER BY, SKIP and LIMIT."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from pyspark.sql import functions as F

from graphloom.errors import SemanticError
from graphloom.functions.registry import AGGREGATES
from graphloom.functions.types import BOOL, NULL, Value
from graphloom.plans import ast as a
from graphloom.plans.scope import Evaluator, Frame, NodeVar, PathVar, RelListVar, RelVar, ValueVar

_ENTITIES = (NodeVar, RelVar, RelListVar, PathVar)


def aggregates_in(expr) -> list[a.Call]:
    """The outermost aggregate calls of an expression."""
    if isinstance(expr, a.Call) and expr.name.lower() in AGGREGATES and (expr.star or len(expr.args) == 1):
        inner = [c for x in expr.args for c in aggregates_in(x)]
        if inner:
            raise SemanticError(f"Aggregation function {inner[0].name} is not allowed in expression {expr}")
        return [expr]
    if isinstance(expr, (list, tuple)):
        return [c for x in expr for c in aggregates_in(x)]
    if is_dataclass(expr):
        return [c for f in fields(expr) for c in aggregates_in(getattr(expr, f.name))]
    return []


class Projector:
    def __init__(self, spark, params: dict, semantics: str, numbers):
        self.spark, self.params, self.semantics, self.numbers = spark, params, semantics, numbers

    def __call__(self, frame: Frame, body: a.Projection) -> Frame:
        items = self._items(frame, body)
        grouped = any(aggregates_in(i.expr) for i in items)
        out = self._grouped(frame, items) if grouped else self._plain(frame, items, body)
        if body.distinct:
            keys = out.columns()
            sort = [c for c in out.df.columns if c.startswith("__sort")]
            out.df = out.df.select(*keys, *sort).dropDuplicates(keys)
        return self._order(out, items, body, grouped)

    def _items(self, frame: Frame, body: a.Projection) -> list[a.Item]:
        """Explicit items first, then, for *, the variables they don't hide."""
        items = []
        for item in body.items:
            if item.alias is None and not body.final and not isinstance(item.expr, a.Variable):
                raise SemanticError(f"Return item {item.expr} must be aliased in {item.expr}")
            items.append(a.Item(item.expr, item.alias or str(item.expr)))
        if body.star:
            named = {i.alias for i in items}
            items += [a.Item(a.Variable(n), n) for n in frame.scope if n not in named]
        if not items:
            raise SemanticError("At least one return item is required in RETURN" if body.final else "At least one return item is required in WITH")
        names = [i.alias for i in items]
        twice = [n for n in names if names.count(n) > 1]
        if twice:
            raise SemanticError(f"Variable '{twice[0]}' is already defined in {', '.join(names)}")
        return items

    def _evaluator(self, frame: Frame, **more) -> Evaluator:
        return Evaluator(frame.scope, self.params, self.semantics, **more)

    def _bind(self, frame: Frame, item: a.Item, evaluator: Evaluator) -> tuple[object, list]:
        """(binding, columns) of an item; entities stay what they are, under another name."""
        if isinstance(item.expr, a.Variable) and isinstance(frame.scope.get(item.expr.name), _ENTITIES):
            var = frame.scope[item.expr.name]
            return var, [F.col(c) for c in var.columns()]
        value = evaluator(item.expr)
        name = f"v{next(self.numbers)}"
        return ValueVar(name, value.type), [value.column.alias(name)]

    def _plain(self, frame: Frame, items: list[a.Item], body: a.Projection) -> Frame:
        evaluator = self._evaluator(frame)
        scope, columns = {}, {}
        for item in items:
            scope[item.alias], made = self._bind(frame, item, evaluator)
            names = scope[item.alias].columns()
            columns |= dict(zip(names, made, strict=True))
        sort = []
        for k, (expr, _) in enumerate(body.order):
            if self._output(items, expr) is None and not self._in_scope(expr, scope):
                if body.distinct:
                    raise SemanticError(f"ORDER BY {expr} is not in the distinct items")
                sort.append(evaluator(expr).column.alias(f"__sort{k}"))
        rows = frame.rows(self.spark)
        return Frame(rows.select(*columns.values(), *sort), scope)

    @staticmethod
    def _output(items: list[a.Item], expr: a.Expr) -> a.Item | None:
        """The item that an ORDER BY expression repeats."""
        return next((i for i in items if str(i.expr) == str(expr) or (isinstance(expr, a.Variable) and i.alias == expr.name)), None)

    @staticmethod
    def _in_scope(expr, scope: dict) -> bool:
        if isinstance(expr, a.Property) and isinstance(expr.base, a.Variable):
            var = scope.get(expr.base.name)
            return not isinstance(var, (NodeVar, RelVar)) or expr.key in var.keys if var is not None else False
        if isinstance(expr, a.Variable):
            return expr.name in scope
        if isinstance(expr, (list, tuple)):
            return all(Projector._in_scope(x, scope) for x in expr)
        if is_dataclass(expr):
            return all(Projector._in_scope(getattr(expr, f.name), scope) for f in fields(expr))
        return True

    def _grouped(self, frame: Frame, items: list[a.Item]) -> Frame:
        evaluator = self._evaluator(frame)
        scope, keys, bound, made = {}, [], {}, []
        for item in items:
            if not aggregates_in(item.expr):
                scope[item.alias], columns = self._bind(frame, item, evaluator)
                keys += columns
                if isinstance(scope[item.alias], ValueVar):
                    bound[str(item.expr)] = Value(F.col(scope[item.alias].name), scope[item.alias].type)
        for call in {str(c): c for i in items for c in aggregates_in(i.expr)}.values():
            value = self._evaluator(frame, aggregates=True)(call)
            name = f"v{next(self.numbers)}"
            made.append(value.column.alias(name))
            bound[str(call)] = Value(F.col(name), value.type)
        rows = frame.rows(self.spark)
        rows = rows.groupBy(*keys).agg(*made)
        after = Evaluator(dict(scope), self.params, self.semantics, bound)
        outer: dict[str, object] = {}
        columns = {}
        for item in items:
            if item.alias in scope:
                var = scope[item.alias]
                columns |= {c: F.col(c) for c in var.columns()}
            else:
                value = after(item.expr)
                var = ValueVar(f"v{next(self.numbers)}", value.type)
                columns[var.name] = value.column.alias(var.name)
            outer[item.alias] = var
        return Frame(rows.select(*columns.values()), outer)

    def _order(self, out: Frame, items: list[a.Item], body: a.Projection, grouped: bool) -> Frame:
        keys = []
        for k, (expr, descending) in enumerate(body.order):
            item = self._output(items, expr)
            if item is not None:
                column = self._sortable(out, item.alias)
            elif f"__sort{k}" in out.df.columns:
                column = F.col(f"__sort{k}")
            else:
                bound = {str(i.expr): self._evaluator(out)(a.Variable(i.alias)) for i in items if isinstance(out.scope[i.alias], ValueVar)}
                column = Evaluator(out.scope, self.params, self.semantics, bound)(expr).column
            keys.append(column.desc_nulls_first() if descending else column.asc_nulls_last())
        df = out.df.orderBy(*keys) if keys else out.df
        if body.skip is not None:
            df = df.offset(self._count(body.skip, "offset"))
        if body.limit is not None and (n := self._count(body.limit, "limit")) >= 0:
            df = df.limit(n)
        extra = [c for c in df.columns if c.startswith("__sort")]
        out = Frame(df.drop(*extra) if extra else df, out.scope)
        if body.where is not None:
            value = self._evaluator(out)(body.where, native=True)
            if value.type not in (BOOL, NULL):
                raise SemanticError(f"Filter expression must be a boolean, got {value.type} in {body.where}")
            out.df = out.df.where(value.column.cast("boolean"))
        return out

    def _sortable(self, out: Frame, alias: str):
        var = out.scope[alias]
        return F.col(var.prefix) if isinstance(var, (NodeVar, RelVar)) else self._evaluator(out)(a.Variable(alias)).column

    def _count(self, expr: a.Expr, what: str) -> int:
        if isinstance(expr, a.Parameter) and isinstance(self.params.get(expr.name), int):
            return self.params[expr.name]
        if isinstance(expr, a.Unary) and expr.op == "-" and isinstance(expr.operand, a.Literal) and isinstance(expr.operand.value, int):
            return -expr.operand.value
        if isinstance(expr, a.Literal) and isinstance(expr.value, int) and not isinstance(expr.value, bool):
            return expr.value
        raise SemanticError(f"Pagination {what} must be an integer in {expr}")
