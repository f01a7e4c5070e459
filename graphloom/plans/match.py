"""MATCH: from patterns to joins."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import NotSupported, SemanticError
from graphloom.operators import expand
from graphloom.plans import ast as a
from graphloom.plans.needs import Need, Needs
from graphloom.plans.scope import Evaluator, Frame, NodeVar, PathVar, RelListVar, RelVar, path_length
from graphloom.sources.graph import PropertyGraph

HIDDEN = "  "  # names of nodes and relationships that have none start with it


@dataclass(eq=False)
class Named:
    """A pattern part with a name for each node and relationship; whole: whether its path is shown."""

    part: a.PatternPart
    nodes: list[str]
    rels: list[str]
    whole: bool


class Matcher:
    """Plans the patterns of one query over one version of the graph."""

    def __init__(self, spark, graph: PropertyGraph, params: dict, needs: Needs, semantics: str = "reference", rel_uniqueness: str = "none"):
        self.spark, self.graph, self.params, self.needs = spark, graph, params, needs
        self.semantics, self.rel_uniqueness = semantics, rel_uniqueness
        self.numbers = itertools.count()
        self.steps: list[str] = []  # the logical plan, line by line
        self._paths: str | None = None  # the selector, while its paths are searched level by level
        #: Tables and needs of an outer node that an optional pattern starts from anew.
        self.seeds: dict[str, tuple[list, Need]] = {}

    def fresh(self, name: str | None) -> str:
        return f"{name or 'anon'}_{next(self.numbers)}"

    def match(self, frame: Frame, clause: a.Match) -> Frame:
        if clause.optional:
            return self._optional(frame, clause)
        return self._parts(frame, clause)

    def _parts(self, frame: Frame, clause: a.Match) -> Frame:
        frame = Frame(frame.df, dict(frame.scope))
        trail = clause.mode == "trail"
        self._rels: list[RelVar | RelListVar] = []
        named = [self._named(p) for p in clause.parts]
        rel_names = [r for n in named for r in n.rels]
        for r in rel_names:
            if rel_names.count(r) > 1 or r in frame.scope:
                raise SemanticError(f"Relationship variable {r} is used more than once in {', '.join(map(str, clause.parts))}")
        if all(n.part.selector == ("all",) and all(isinstance(r, a.RelPattern) for r in n.part.chain.rels) for n in named):
            frame = self._joined(frame, named, trail)
        else:
            waiting = list(named)
            while waiting:
                # A part that shares a variable with the rows so far is joined before any other.
                one = next((n for n in waiting if any(x in frame.scope for x in n.nodes)), waiting[0])
                waiting.remove(one)
                frame = self._part(frame, one, trail)
        if self.rel_uniqueness == "trail" and trail:
            frame = self._unique(frame)
        if clause.where is not None:
            frame.df = frame.df.where(self._evaluator(frame).condition(clause.where))
            self.steps.append(f"Filter {clause.where}")
        return frame

    def _evaluator(self, frame: Frame) -> Evaluator:
        return Evaluator(frame.scope, self.params, self.semantics)

    def _unique(self, frame: Frame) -> Frame:
        """No relationship twice in a MATCH."""
        for x, y in itertools.combinations(self._rels, 2):
            if isinstance(x, RelVar) and isinstance(y, RelVar):
                same = F.col(x.prefix) == F.col(y.prefix)
            else:
                lists = [F.col(f"{v.prefix}__ids") if isinstance(v, RelListVar) else F.array(F.col(v.prefix)) for v in (x, y)]
                same = F.arrays_overlap(*lists)
            frame.df = frame.df.where(~same)
        return frame

    def _optional(self, frame: Frame, clause: a.Match) -> Frame:
        """Rows without a match stay once, with nulls. The pattern is matched once for each distinct
        set of the outer values that it uses, then joined back to the rows."""
        outer = frame.rows(self.spark)
        used = self._used(clause)
        imported = {k: v for k, v in frame.scope.items() if k in used}
        keys = list(dict.fromkeys(c for v in imported.values() for c in v.columns()))
        if frame.df is None or not keys:
            inner = self._parts(Frame(None, {}), clause)
            scope = {**frame.scope, **inner.scope}
            joined = outer.join(inner.df, F.lit(True), "left")
            return Frame(joined, scope)
        hops = sum(1 if isinstance(r, a.RelPattern) and r.length is None else 2 for p in clause.parts for r in p.chain.rels)
        if len(imported) == 1 and hops == 1 and len(clause.parts) == 1 and not clause.parts[0].variable:
            # One hop from one node: its table has to be read anyway, so it is joined as it is.
            (name, var), *_ = imported.items()
            if isinstance(var, NodeVar) and sum(n.variable == name for n in clause.parts[0].chain.nodes) == 1:
                self.seeds = {name: (var.tables, Needs([clause.parts, clause.where]).of[name])}
                inner = self._parts(Frame(None, {}), clause)
                self.seeds = {}
                own = inner.scope.pop(name)
                rows = inner.df.select(F.col(own.prefix).alias("__in"), *inner.columns())
                self.steps.append("Optional")
                return Frame(outer.join(rows, F.col(var.prefix) == F.col("__in"), "left").drop("__in"), {**frame.scope, **inner.scope})
        inner = self._parts(Frame(outer.select(*keys).distinct(), imported), clause)
        new = [c for c in inner.columns() if c not in keys]
        renamed = inner.df.select(*[F.col(c).alias(f"__in_{c}") for c in keys], *new)
        on: Column = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"__in_{c}"))
        joined = outer.join(renamed, on, "left").drop(*[f"__in_{c}" for c in keys])
        self.steps.append("Optional")
        return Frame(joined, {**frame.scope, **{k: v for k, v in inner.scope.items() if k not in frame.scope}})

    def _used(self, clause: a.Match) -> set[str]:
        own = Needs([clause.parts, clause.where])
        named = {n.variable for p in clause.parts for n in p.chain.nodes if n.variable}
        return named | set(own.of)

    # Parts

    def _named(self, part: a.PatternPart) -> Named:
        nodes = [n.variable or HIDDEN + self.fresh("node") for n in part.chain.nodes]
        rels = [getattr(r, "variable", None) or HIDDEN + self.fresh("rel") for r in part.chain.rels]
        return Named(part, nodes, rels, part.variable is not None and self.needs.whole(part.variable))

    def _joined(self, frame: Frame, named: list[Named], trail: bool) -> Frame:
        """All steps of all parts, in an order that keeps the rows few: first those between two bound
        nodes, then those that find one row at most for each (the node's own row holds the
        relationship), then those from a node of which no two rows have the same (they find each
        relationship once at most), then others, variable lengths last; among equals, as written."""
        before = list(frame.scope)
        unique: set[str] = set()  # nodes that differ from row to row
        pool = [(n, i) for n in named for i in range(len(n.rels))]
        done: set[tuple[int, int]] = set()  # mentions of nodes whose labels and conditions are met

        def meet(frame: Frame, n: Named, i: int) -> Frame:
            if (id(n), i) in done:
                return frame
            done.add((id(n), i))
            return self._node(frame, n.nodes[i], n.part.chain.nodes[i], n.whole)

        def take(frame: Frame, n: Named, i: int, backwards: bool, from_node=None) -> Frame:
            at, to = (i + 1, i) if backwards else (i, i + 1)
            if from_node is None:
                frame = meet(frame, n, at)
            done.update({(id(n), at), (id(n), to)})
            chain = n.part.chain
            return self._step(frame, n.nodes[at], chain.rels[i], n.rels[i], n.nodes[to], chain.nodes[to], trail, n.whole, backwards, from_node)

        while pool:
            ready = [(self._fan_out(frame, n, i, unique), k) for k, (n, i) in enumerate(pool) if n.nodes[i] in frame.scope or n.nodes[i + 1] in frame.scope]
            if ready:
                (_, most_one, holds_end), k = min(ready)
                n, i = pool.pop(k)
                backwards = n.nodes[i] not in frame.scope
                ends = (n.nodes[i + 1], n.nodes[i]) if backwards else (n.nodes[i], n.nodes[i + 1])
                if not most_one:
                    unique = {ends[1]} if ends[0] in unique and ends[1] not in frame.scope and holds_end else set()
                frame = take(frame, n, i, backwards)
                continue
            n, i = pool[0]
            first = frame.df is None
            unread = self._unread(frame, n.nodes[0], n.part.chain, n.whole) if i == 0 else None
            if unread is None:
                frame = meet(frame, n, i)
                unique = {n.nodes[i]} if first else set()
            else:
                pool.pop(0)
                frame = Frame(frame.df, {**frame.scope, n.nodes[0]: unread})
                _, most_one, holds_end = self._fan_out(frame, n, 0, set())
                unique = set() if not first else {n.nodes[0]} if most_one else {n.nodes[1]} if holds_end else set()
                frame = take(frame, n, 0, False, n.part.chain.nodes[0])
        for n in named:
            for i in range(len(n.nodes)):
                frame = meet(frame, n, i)
        ordered = dict.fromkeys([*before, *(x for n in named for x in (*n.nodes, *n.rels))])
        scope = {x: frame.scope[x] for x in ordered if not x.startswith(HIDDEN)}
        for n in named:
            if n.part.variable:
                scope[n.part.variable] = PathVar(self._path(frame, n))
        return Frame(frame.df, scope)

    def _fan_out(self, frame: Frame, n: Named, i: int, unique: set[str]) -> tuple[int, bool, bool]:
        """(rank, whether each row finds one at most, whether the found end's row is the relationship)."""
        rel, ends = n.part.chain.rels[i], (n.nodes[i], n.nodes[i + 1])
        bound = [x in frame.scope for x in ends]
        if rel.length is not None:
            return 4, False, False
        backwards = not bound[0]
        direction = {a.OUT: a.IN, a.IN: a.OUT}.get(rel.direction, rel.direction) if backwards else rel.direction
        start, to = frame.scope[ends[backwards]], n.part.chain.nodes[i if backwards else i + 1]
        found = expand.branches(self.graph, rel.types, direction)
        if isinstance(start, NodeVar):
            found, _, _ = expand.feasible(found, start.tables, self._candidates(to.labels), self.graph.nodes)
        most_one = len(found) == 1 and found[0].table.row_side == found[0].src
        holds_end = len(found) == 1 and found[0].table.row_side == found[0].dst
        return (0 if all(bound) else 1 if most_one else 2 if ends[backwards] in unique else 3), most_one, holds_end

    @staticmethod
    def _path(frame: Frame, n: Named) -> list:
        steps = [frame.scope[n.nodes[0]]]
        for r, x in zip(n.rels, n.nodes[1:], strict=True):
            steps += [frame.scope[r], frame.scope[x]]
        return steps

    def _part(self, frame: Frame, named: Named, trail: bool) -> Frame:
        """One part by itself, in the order of its chain."""
        part, names, rel_names, whole = named.part, named.nodes, named.rels, named.whole
        chain, before = part.chain, list(frame.scope)
        self._paths = self._by_levels(part)
        at = next((i for i, n in enumerate(names) if n in frame.scope), 0)
        unread = self._unread(frame, names[at], chain, whole)
        frame = Frame(frame.df, {**frame.scope, names[at]: unread}) if unread else self._node(frame, names[at], chain.nodes[at], whole)
        for i in range(at, len(chain.rels)):
            frame = self._step(frame, names[i], chain.rels[i], rel_names[i], names[i + 1], chain.nodes[i + 1], trail, whole, False, chain.nodes[0] if unread and i == 0 else None)
        for i in range(at - 1, -1, -1):
            frame = self._step(frame, names[i + 1], chain.rels[i], rel_names[i], names[i], chain.nodes[i], trail, whole, True)
        steps = self._path(frame, named)
        if self._paths:
            self.steps.append(f"Select {' '.join(map(str, part.selector))} by levels")
            self._paths = None
        else:
            frame = self._select(frame, part.selector, steps, names)
        # Nodes come before relationships where all variables are listed.
        ordered = dict.fromkeys([*before, *names, *rel_names])
        frame.scope = {n: frame.scope[n] for n in ordered if not n.startswith(HIDDEN)}
        if part.variable:
            frame.scope[part.variable] = PathVar(steps)
        return frame

    def _shortest(self, df: DataFrame, steps: DataFrame, var: RelListVar, start: str, target: str, bound: NodeVar | None, rel: a.RelPattern, trail: bool) -> DataFrame:
        """df with the shortest paths from start, or to the bound end, searched level by level."""
        low, high = rel.length
        ends = df.select(start).distinct() if bound is None else df.select(start, F.col(bound.prefix).alias(target)).distinct()
        found = expand.shortest(ends, steps, var, start, target, low, high, self._paths == "all shortest", trail and rel.direction == a.BOTH, bound is not None)
        return df.join(found, start)

    def _by_levels(self, part: a.PatternPart) -> str | None:
        """The selector, if the part's paths are one variable length of which the shortest are asked for."""
        selector, rels = part.selector, part.chain.rels
        if len(rels) != 1 or not isinstance(rels[0], a.RelPattern) or rels[0].length is None or rels[0].length[0] > 1:
            return None
        one = selector[0] in ("any", "shortest") and (len(selector) == 1 or selector[1] == 1)
        return selector[0] if one or selector[0] == "all shortest" else None

    def _select(self, frame: Frame, selector: tuple, steps: list, names: list[str]) -> Frame:
        """Keeps some of the paths between each pair of ends, the shorter first."""
        if selector[0] == "all":
            return frame
        ends = [F.col(frame.scope[names[0]].prefix), F.col(frame.scope[names[-1]].prefix)]
        order = Window.partitionBy(*ends).orderBy(path_length(PathVar(steps)))
        rank = {"any": F.row_number, "shortest": F.row_number, "groups": F.dense_rank, "all shortest": F.rank}[selector[0]]()
        most = selector[1] if len(selector) > 1 else 1
        self.steps.append(f"Select {' '.join(map(str, selector))}")
        frame.df = frame.df.withColumn("__rank", rank.over(order)).where(F.col("__rank") <= most).drop("__rank")
        return frame

    def _candidates(self, labels: a.LabelExpr | None):
        return self.graph.nodes if labels is None else [t for t in self.graph.nodes if labels.holds(t.labels)]

    def _need(self, name: str, whole: bool) -> Need:
        hidden = name.startswith(HIDDEN)
        need = Need(set() if hidden else set(self.needs.of[name].keys), whole or (not hidden and self.needs.whole(name)), not hidden and self.needs.of[name].labels)
        return need

    def _new_node(self, name: str, pattern: a.NodePattern, tables, whole: bool) -> NodeVar:
        need = self._need(name, whole)
        if name in self.seeds:
            seeded, need = self.seeds[name]
            tables = [t for t in tables if any(t is x for x in seeded)]
        keys = need.keys | {k for k, _ in (pattern.properties.items if pattern.properties else ())} | _keys_of(pattern.where, pattern.variable)
        var = NodeVar(self.fresh(name.strip()), list(tables), set(), need.whole, need.labels or _asks_labels(pattern))
        types = var.types()
        var.keys = set(types) if need.whole else {k for k in keys if k in types}
        return var

    def _node(self, frame: Frame, name: str, pattern: a.NodePattern, whole: bool) -> Frame:
        """The pattern's node, bound by now or scanned."""
        var = frame.scope.get(name)
        tables = self._candidates(pattern.labels)
        if var is None:
            var = self._new_node(name, pattern, tables, whole)
            rows = expand.scan_nodes(self.spark, var)
            self.steps.append(f"Scan {name.strip()} {[':'.join(t.labels) for t in var.tables]}")
            frame = Frame(rows if frame.df is None else frame.df.crossJoin(rows), {**frame.scope, name: var})
        elif not isinstance(var, NodeVar):
            raise SemanticError(f"Variable {name} is not a node in {pattern}")
        else:
            frame = self._restrict(frame, name, var, tables)
        return self._inline(frame, name, pattern)

    def _unread(self, frame: Frame, name: str, chain: a.Chain, whole: bool) -> NodeVar | None:
        """The first node, if its table need not be read: all that the first relationship starts
        from is of its label, and only its id is used, or its row is the relationship's own."""
        node, rel = chain.nodes[0], chain.rels[0] if chain.rels else None
        if name in frame.scope or not isinstance(rel, a.RelPattern) or rel.length is not None:
            return None
        tables = self._candidates(node.labels)
        var = self._new_node(name, node, tables, whole)
        tables = var.tables
        if name == (chain.nodes[1].variable or ""):
            return None
        found = expand.branches(self.graph, rel.types, rel.direction)
        kept, _, _ = expand.feasible(found, tables, self._candidates(chain.nodes[1].labels), self.graph.nodes)
        if (var.keys or var.labels) and not expand.in_row(kept, "src", tables, self.graph.nodes):
            return None
        allowed = {id(t) for t in tables}
        certain = all(id(t) in allowed for b in kept for t in expand.with_label(self.graph.nodes, b.src_label))
        return var if certain else None

    def _restrict(self, frame: Frame, name: str, var: NodeVar, tables) -> Frame:
        """Labels asked of a bound node: other tables' nodes go."""
        kept = [t for t in var.tables if any(t is x for x in tables)]
        if len(kept) == len(var.tables):
            return frame
        if var.labels:
            allowed = [F.col(f"{var.prefix}__labels") == F.array(*[F.lit(x) for x in t.labels]) for t in kept]
            test = F.lit(False)
            for x in allowed:
                test = test | x
            df = frame.df.where(test)
        else:
            ids = expand.scan_nodes(self.spark, NodeVar("__allowed", kept))
            df = frame.df.join(ids, F.col(var.prefix) == F.col("__allowed"), "left_semi")
        return Frame(df, {**frame.scope, name: var})

    def _inline(self, frame: Frame, name: str, pattern: a.NodePattern | a.RelPattern) -> Frame:
        """Properties and WHERE written inside a pattern."""
        tests = [a.Binary("=", a.Property(a.Variable(name), k), v) for k, v in (pattern.properties.items if pattern.properties else ())]
        if pattern.where is not None:
            tests.append(pattern.where)
        for test in tests:
            frame = Frame(frame.df.where(self._evaluator(frame).condition(test)), frame.scope)
            self.steps.append(f"Filter {test}")
        return frame

    def _step(self, frame: Frame, from_: str, rel, rel_name: str, to: str, node: a.NodePattern, trail: bool, whole: bool, backwards: bool, from_node: a.NodePattern | None = None) -> Frame:
        """from_node: the pattern of the node that the step starts from, if it has no columns yet and
        the relationships bring them."""
        unread = from_node is not None
        if isinstance(rel, a.Quantified):
            return self._quantified(frame, from_, rel, rel_name, to, node, trail, backwards)
        direction = {a.OUT: a.IN, a.IN: a.OUT}.get(rel.direction, rel.direction) if backwards else rel.direction
        start: NodeVar = frame.scope[from_]
        bound = frame.scope.get(to)
        if bound is not None and not isinstance(bound, NodeVar):
            raise SemanticError(f"Variable {to} is not a node in {node}")
        tables = self._candidates(node.labels) if bound is None else bound.tables
        found = expand.branches(self.graph, rel.types, direction)
        if rel.length is None:
            kept, led, certain = expand.feasible(found, start.tables, tables, self.graph.nodes)
        else:
            kept, led, certain = found, tables, False
        need = self._need(rel_name, whole)
        target = self.fresh("end")
        if rel.length is None:
            var = RelVar(self.fresh(rel_name.strip()), [b.table for b in (kept or found)], set(), need.whole)
            types = var.types()
            keys = need.keys | {k for k, _ in (rel.properties.items if rel.properties else ())} | _keys_of(rel.where, rel.variable)
            var.keys = set(types) if need.whole else {k for k in keys if k in types}
            named = not rel_name.startswith(HIDDEN)
            var.has_id = need.whole or self.rel_uniqueness == "trail" or (named and self._id_used(rel_name))
            source = start.prefix if unread else self.fresh("start")
            end = None if bound is not None else self._new_node(to, node, led, whole)
            own = end is not None and bool(end.keys or end.labels) and expand.in_row(kept, "dst", led, self.graph.nodes)
            if own:
                certain = True
            read = start if unread and (start.keys or start.labels) else None
            if read and own:
                own, certain = False, False  # one row can't be both ends' nodes
            rows = expand.scan_rels(self.spark, kept, var, source, target, read, end if own else None)
            on = F.lit(True) if unread else F.col(start.prefix) == F.col(source)
            if bound is not None:
                on = on & (F.col(bound.prefix) == F.col(target))
            if unread:
                df = rows if frame.df is None else frame.df.join(rows, on) if bound is not None else frame.df.crossJoin(rows)
            else:
                df = frame.df.join(rows, on).drop(source)
            frame = Frame(df, {**frame.scope, rel_name: var})
            self.steps.append(f"Expand{'Into' if bound else 'All'} {from_.strip()} {rel} {to.strip()} {[b.table.type for b in kept]}")
            frame = self._inline(frame, rel_name, rel)
            if unread:
                frame = self._inline(frame, from_, from_node)
        else:
            var = RelListVar(self.fresh(rel_name.strip()), [b.table for b in found], need.whole)
            steps = expand.step_rows(self.spark, found, var, [])
            if rel.properties or rel.where is not None:
                steps = self._filtered_steps(found, var, rel, rel_name)
            low, high = rel.length
            if self._paths:
                df = self._shortest(frame.df, steps, var, start.prefix, target, bound, rel, trail)
            else:
                df = expand.var_expand(frame.df, steps, var, start.prefix, target, low, high, trail)
            if backwards:
                df = df.withColumn(f"{var.prefix}__ids", F.reverse(f"{var.prefix}__ids"))
                df = df.withColumn(f"{var.prefix}__rels", F.reverse(f"{var.prefix}__rels")) if var.whole else df
            if bound is not None:
                df = df.where(F.col(bound.prefix) == F.col(target))
            frame = Frame(df, {**frame.scope, rel_name: var})
            self.steps.append(f"VarExpand{'Into' if bound else 'All'} {from_.strip()} {rel} {to.strip()} {'trail' if trail else 'walk'}")
        self._rels.append(var)
        if bound is not None:
            frame = Frame(frame.df.drop(target), frame.scope)
            return self._node(frame, to, node, whole)
        if rel.length is not None:
            end, own = self._new_node(to, node, led, whole), False
        if own or (certain and not end.keys and not end.labels):
            df = frame.df.withColumnRenamed(target, end.prefix)
        else:
            df = frame.df.join(expand.scan_nodes(self.spark, end), F.col(target) == F.col(end.prefix)).drop(target)
        return self._inline(Frame(df, {**frame.scope, to: end}), to, node)

    def _id_used(self, name: str) -> bool:
        """Whether something may ask which relationship it is."""
        return name in self.needs.of or self.needs.everything

    def _filtered_steps(self, found, var: RelListVar, rel: a.RelPattern, name: str) -> DataFrame:
        """Steps whose relationship meets the pattern's own conditions, tested before the expansion."""
        one = RelVar("__rel", var.tables, set(), True, True)
        one.keys = set(one.types())
        rows = expand.scan_rels(self.spark, found, one, "src", "dst")
        frame = self._inline(Frame(rows, {name: one}), name, rel)
        rel_struct = self._evaluator(frame)(a.Variable(name)).column
        out = frame.df.select("src", "dst", F.col("__rel").alias("rid"), rel_struct.alias("rel"))
        return out if var.whole else out.drop("rel")

    def _quantified(self, frame: Frame, from_: str, part: a.Quantified, rel_name: str, to: str, node: a.NodePattern, trail: bool, backwards: bool) -> Frame:
        """A chain repeated: its body is planned once as a table of (src, dst, ids), then expanded.

        Its inner variables are not visible outside.
        """
        if backwards:
            raise NotSupported(f"a quantified path pattern before the first bound node in {part}")
        inner = Matcher(self.spark, self.graph, self.params, Needs([part.chain, part.where]), self.semantics, self.rel_uniqueness)
        inner._rels = []
        for r in part.chain.rels:
            if isinstance(r, a.Quantified) or r.length is not None:
                raise NotSupported(f"variable length within a quantified path pattern in {part}")
        ends = [part.chain.nodes[0].variable or "__first", part.chain.nodes[-1].variable or "__last"]
        if ends[0] == ends[1]:
            raise NotSupported(f"a quantified path pattern that ends where it starts in {part}")
        nodes = list(part.chain.nodes)
        nodes[0], nodes[-1] = replace(nodes[0], variable=ends[0]), replace(nodes[-1], variable=ends[1])
        rels = [replace(r, variable=r.variable or f"__r{i}") for i, r in enumerate(part.chain.rels)]
        for r in rels:
            inner.needs.of[r.variable].whole = True
        chain = a.Chain(tuple(nodes), tuple(rels))
        body = inner._parts(Frame(None, {}), a.Match([a.PatternPart(None, ("all",), chain)], part.where, False, "trail" if trail else "walk"))
        relvars = [body.scope[r.variable] for r in rels]
        ids = [F.col(v.prefix) for v in relvars]
        df = body.df
        if trail:
            for x, y in itertools.combinations(ids, 2):
                df = df.where(x != y)
        steps = df.select(F.col(body.scope[ends[0]].prefix).alias("src"), F.col(body.scope[ends[1]].prefix).alias("dst"), F.array(*ids).alias("rids"))
        start: NodeVar = frame.scope[from_]
        var = RelListVar(self.fresh("rels"), [t for v in relvars for t in v.tables])
        target = self.fresh("end")
        df = _expand_groups(frame.df, steps, var, start.prefix, target, part.low, part.high, trail)
        self.steps.append(f"Quantified {from_.strip()} {part} {to.strip()}")
        frame = Frame(df, {**frame.scope, rel_name: var})
        bound = frame.scope.get(to)
        if bound is not None:
            frame = Frame(df.where(F.col(bound.prefix) == F.col(target)).drop(target), frame.scope)
            return self._node(frame, to, node, False)
        end = self._new_node(to, node, self._candidates(node.labels), False)
        df = df.join(expand.scan_nodes(self.spark, end), F.col(target) == F.col(end.prefix)).drop(target)
        return self._inline(Frame(df, {**frame.scope, to: end}), to, node)


def _expand_groups(df, steps, var, start, end, low, high, trail):
    """var_expand() where a step has several relationships."""
    from graphloom.sources.shared import materialize

    if high is None and not trail:
        raise NotSupported("a walk without an upper bound may never end")
    ids = f"{var.prefix}__ids"
    front = df.withColumn(end, F.col(start)).withColumn(ids, F.array().cast("array<bigint>"))
    found = [front] if low == 0 else []
    length = 0
    while high is None or length < high:
        length += 1
        joined = front.join(steps, F.col(end) == F.col("src"))
        if trail:
            joined = joined.where(~F.arrays_overlap(F.col(ids), F.col("rids")))
        front = joined.withColumn(ids, F.concat(ids, "rids")).withColumn(end, F.col("dst")).select(*front.columns)
        if high is None or high > expand.UNROLLED:
            front = materialize(front)
            if front.isEmpty():
                break
        if length >= low:
            found.append(front)
    return expand.union_all(found) if found else front.where(F.lit(False))


def _asks_labels(pattern: a.NodePattern) -> bool:
    return pattern.where is not None and pattern.variable is not None and Needs([pattern.where]).of[pattern.variable].labels


def _keys_of(where: a.Expr | None, variable: str | None) -> set[str]:
    return Needs([where]).of[variable].keys if where is not None and variable else set()
