"""A plain matcher over lists, and printed forms, for tests to hold queries against."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Stop:
    """A node of the plain map; id is the number that CREATE gives it."""

    id: int
    labels: tuple[str, ...]
    props: dict = field(hash=False)


@dataclass(frozen=True)
class Way:
    id: int
    kind: str
    start: int
    end: int
    props: dict = field(hash=False)


def value(x) -> str:
    """How results are printed: whole floats without a point, texts quoted, null."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return f"'{x}'"
    if isinstance(x, float):
        return "NaN" if x != x else str(int(x)) if x in (int(x) if abs(x) != float("inf") else x,) and abs(x) < 1e15 else str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(value, x)) + "]"
    return str(x)


def line(*xs) -> str:
    return "\t".join(map(value, xs))


def literal(props: dict) -> str:
    return "{" + ", ".join(f"{k}: {value(v)}" for k, v in props.items()) + "}"


class Map:
    """A random multigraph: stops of two labels, ways of two kinds, a loop and parallel ways."""

    def __init__(self, seed: int = 3, stops: int = 7, ways: int = 13):
        rng = random.Random(seed)
        self.stops = []
        for i in range(1, stops + 1):
            labels = ("Depot",) if i % 3 else ("Depot", "Hub") if i % 2 else ("Hub",)
            props = {"code": f"s{i}", "bays": rng.randint(1, 4)} | ({"zone": rng.choice("NE")} if i % 2 else {})
            self.stops.append(Stop(i, labels, props))
        ends = [(2, 2), (1, 4), (1, 4)] + [(rng.randint(1, stops), rng.randint(1, stops)) for _ in range(ways - 3)]
        self.ways = [Way(k, "ROAD" if k % 3 else "RAIL", a, b, {"no": k, "km": rng.randint(1, 9) / 2}) for k, (a, b) in enumerate(ends, 1)]
        self.of = {s.id: s for s in self.stops}

    def create(self) -> str:
        nodes = [f"(n{s.id}:{':'.join(s.labels)} {literal(s.props)})" for s in self.stops]
        rels = [f"(n{w.start})-[:{w.kind} {literal(w.props)}]->(n{w.end})" for w in self.ways]
        return "CREATE " + ", ".join(nodes + rels)

    def code(self, i: int) -> str:
        return self.of[i].props["code"]

    def steps(self, way: str = ">", kinds: tuple[str, ...] = ("ROAD", "RAIL")) -> list[tuple[int, Way, int]]:
        """(from, way, to): along it (>), against it (<) or either way (-), a loop then twice."""
        out = [(w.start, w, w.end) for w in self.ways if w.kind in kinds and way in ">-"]
        return out + [(w.end, w, w.start) for w in self.ways if w.kind in kinds and way in "<-"]

    def trails(self, low: int, high: int, way: str = ">", kinds: tuple[str, ...] = ("ROAD", "RAIL"), walk: bool = False) -> list[tuple[int, list[Way], int]]:
        """(from, ways, to) of low to high steps; no way twice unless walk."""
        steps = self.steps(way, kinds)
        front = [(s.id, [], s.id) for s in self.stops]
        out = list(front) if not low else []
        for n in range(1, high + 1):
            front = [(a, [*ways, w], c) for a, ways, b in front for x, w, c in steps if x == b and (walk or w not in ways)]
            if not front:
                break
            out += front if n >= low else []
        return out

    def node_text(self, i: int) -> str:
        s = self.of[i]
        return f"{{id: {s.id}, labels: [{', '.join(s.labels)}], props: {literal(s.props)}}}"

    @staticmethod
    def way_text(w: Way) -> str:
        return f"{{id: {w.id}, rtype: {w.kind}, start: {w.start}, end: {w.end}, props: {literal(w.props)}}}"
