"""Static types of expressions, and their Spark representations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    """A type by name; item: of a list; fields: of a map; props: what is known of an entity's
    properties, which doesn't tell types apart."""

    name: str
    item: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()
    props: tuple[tuple[str, Type], ...] = field(default=(), compare=False)

    def __str__(self):
        return f"List<{self.item}>" if self.name == "List" else self.name


NULL, BOOL, INT, FLOAT, STRING = Type("Null"), Type("Bool"), Type("Integer"), Type("Float"), Type("String")
DATE, LOCAL_TIME, LOCAL_DATE_TIME = Type("Date"), Type("LocalTime"), Type("LocalDateTime")
DATE_TIME, DURATION = Type("ZonedDateTime"), Type("Duration")
NODE, REL, PATH, ANY = Type("Node"), Type("Rel"), Type("Path"), Type("Any")
NUMBERS = (INT, FLOAT)
TEMPORAL = (DATE, LOCAL_TIME, LOCAL_DATE_TIME, DATE_TIME)

DATE_TIME_SPARK = "struct<utc:timestamp_ntz,offset_s:int>"
#: A value among others of other types: the name of its type and its printed form.
ANY_SPARK = "struct<t:string,v:string>"
LOCAL_TIME_SPARK = "struct<ns:bigint>"
DURATION_SPARK = "struct<months:bigint,days:bigint,seconds:bigint,nanos:bigint>"


def list_of(item: Type) -> Type:
    return Type("List", item)


def map_of(fields: dict[str, Type]) -> Type:
    return Type("Map", fields=tuple(fields.items()))


@dataclass
class Value:
    """A column with its static type. entity: the variable of a node or relationship."""

    column: Column
    type: Type
    entity: object = None
    constant: object = field(default=None, repr=False)


def of_spark(kind: T.DataType) -> Type:
    """The type of a Spark column; 32-bit and decimal numbers are widened."""
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, T.DateType):
        return DATE
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return LOCAL_DATE_TIME
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, T.ArrayType):
        return list_of(of_spark(kind.elementType))
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        if names == ["utc", "offset_s"]:
            return DATE_TIME
        if names == ["t", "v"]:
            return ANY
        if names == ["ns"]:
            return LOCAL_TIME
        if names == ["months", "days", "seconds", "nanos"]:
            return DURATION
        if names[:2] == ["id", "labels"]:
            return NODE
        if names[:2] == ["id", "rtype"]:
            return REL
        if names == ["nodes", "rels"]:
            return PATH
        return map_of({f.name: of_spark(f.dataType) for f in kind.fields})
    return STRING


def spark_type(kind: Type) -> str:
    """The Spark type, as DDL, of values of a storable type."""
    if kind.name == "List":
        return f"array<{spark_type(kind.item)}>"
    if kind.name == "Map":
        inside = ",".join(f"`{k}`:{spark_type(v)}" for k, v in kind.fields)
        return f"struct<{inside}>"
    plain = {
        BOOL: "boolean", INT: "bigint", FLOAT: "double", STRING: "string", DATE: "date", LOCAL_TIME: LOCAL_TIME_SPARK,
        LOCAL_DATE_TIME: "timestamp_ntz", DATE_TIME: DATE_TIME_SPARK, DURATION: DURATION_SPARK, NULL: "void", ANY: ANY_SPARK,
    }
    return plain[kind]


def common(types: list[Type]) -> Type:
    """The type that holds all of some values; ANY if they only go together with their types by their side."""
    known = [t for t in types if t != NULL]
    if not known:
        return NULL
    if all(t == known[0] for t in known):
        return known[0]
    if all(t in NUMBERS for t in known):
        return FLOAT
    if all(t.name == "List" for t in known):
        return list_of(common([t.item for t in known]))
    return ANY
