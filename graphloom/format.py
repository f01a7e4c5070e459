"""Result rows as text."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Row


def text_of(value, top: bool = True) -> str:
    """A collected value as query results show it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if value != value:
            return "NaN"
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, datetime.datetime):
        return _moment(value)
    if isinstance(value, list):
        return f"[{', '.join(text_of(v) for v in value)}]"
    if isinstance(value, Row):
        return _struct(value)
    return str(value)


def _moment(value: datetime.datetime) -> str:
    text = f"{value:%H:%M:%S}"
    if value.microsecond:
        digits = f"{value.microsecond:06d}"
        text += "." + (digits[:3] if digits.endswith("000") else digits)
    return f"{value.year:04d}-{value.month:02d}-{value.day:02d} {text}"


def _props(value: Row) -> str:
    props = value["props"] if "props" in value else None
    shown = {k: props[k] for k in (props.__fields__ if props is not None else ()) if props[k] is not None}
    return "{" + ", ".join(f"{k}: {text_of(v)}" for k, v in shown.items()) + "}"


def _struct(value: Row) -> str:
    names = value.__fields__
    if names[:2] == ["id", "labels"]:
        if value["labels"] is None:
            return str(value["id"])
        return f"{{id: {value['id']}, labels: [{', '.join(value['labels'])}], props: {_props(value)}}}"
    if names[:2] == ["id", "rtype"]:
        return f"{{id: {value['id']}, rtype: {value['rtype']}, start: {value['start']}, end: {value['end']}, props: {_props(value)}}}"
    if names == ["nodes", "rels"]:
        return _path(value)
    if names == ["t", "v"]:
        return f"'{value['v']}'" if value["t"] == "String" else value["v"]
    if names == ["ns"]:
        seconds, nanos = divmod(value["ns"], 1_000_000_000)
        text = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
        return text + (f".{nanos:09d}".rstrip("0") if nanos else "")
    if names == ["utc", "offset_s"]:
        size = abs(value["offset_s"])
        zone = f"{'-' if value['offset_s'] < 0 else '+'}{size // 3600:02d}:{size // 60 % 60:02d}"
        return f"{_moment(value['utc'] + datetime.timedelta(seconds=value['offset_s']))} {zone}"
    if names == ["months", "days", "seconds", "nanos"]:
        return f"P{value['months']}M{value['days']}DT{value['seconds']}S{value['nanos']}"
    return "{" + ", ".join(f"{k}: {text_of(value[k])}" for k in names) + "}"


def _path(value: Row) -> str:
    """The first node in full, the others by id; arrows show how a relationship is stored."""
    nodes = value["nodes"]
    text = f"({text_of(nodes[0])})"
    for at, (rel, node) in enumerate(zip(value["rels"], nodes[1:], strict=True)):
        left, right = ("-", "->") if rel["start"] == nodes[at]["id"] else ("<-", "-")
        text += f"{left}[{text_of(rel)}]{right}({node['id']})"
    return text


def rows_of(df: DataFrame) -> list[str]:
    """Every row as text, tabs between columns. For results that fit the driver."""
    return ["\t".join(text_of(v) for v in row) for row in df.collect()]
