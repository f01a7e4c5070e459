"""Expressions without a graph: rules over generated inputs, and single cases for printed forms and errors."""

import calendar
import datetime
import itertools
import math
import random

import pytest
from plain import line, value

from graphloom.errors import SemanticError
from graphloom.format import rows_of
from graphloom.session import GraphSession


@pytest.fixture(scope="module")
def g(spark):
    return GraphSession(spark)


def shown(g, text):
    return rows_of(g.cypher(f"RETURN {text}"))[0]


def hold(g, cases):
    """Each (expression, printed result), many to a query."""
    cases = list(cases)
    for k in range(0, len(cases), 60):
        part = cases[k : k + 60]
        got = shown(g, ", ".join(f"{text} AS c{i}" for i, (text, _) in enumerate(part))).split("\t")
        assert dict(zip((t for t, _ in part), got, strict=True)) == dict(part)


def written(x) -> str:
    return repr(x) if not isinstance(x, (bool, str)) and x is not None else value(x)


SIGNED = (7, -7, 3, -3, 2.5, -2.5)


def test_arithmetic(g):
    """Whole numbers divide towards zero and the remainder has the dividend's sign; one fraction makes all fractions."""
    cases = []
    for a, b in itertools.product(SIGNED, SIGNED):
        whole = isinstance(a, int) and isinstance(b, int)
        quotient = int(a / b) if whole else a / b
        results = {"+": a + b, "-": a - b, "*": a * b, "/": quotient, "%": a - b * int(a / b) if whole else math.fmod(a, b)}
        cases += [(f"({a}) {op} ({b})", value(x)) for op, x in results.items()]
    hold(g, cases)
    hold(g, [(f"{a} ^ {b}", value(float(a) ** b)) for a in (1, 2, 9, 0.25) for b in (0, 1, 3, 0.5)])
    hold(g, [(f"null {op} {a}", "null") for op in "+-*/%^" for a in (1, 2.5, "null")])
    hold(g, [("8.0 / 0", "inf"), ("-8 / 0.0", "-inf"), ("7 % 0.0", "NaN"), ("3 ^ 2 ^ 0", "1"), ("2 ^ 2 ^ 3", "64"), ("- 3 ^ 2", "9"), ("-(-(4))", "4")])


def test_precedence(g):
    rng = random.Random(8)

    def made(depth):
        if not depth:
            return str(rng.randint(1, 9))
        text = f"{made(depth - 1)} {rng.choice('+-*')} {made(rng.randint(0, depth - 1))}"
        return f"({text})" if rng.random() < 0.4 else text

    hold(g, [(text, value(eval(text))) for text in (made(4) for _ in range(50))])  # noqa: S307


def test_text_is_joined(g):
    cases = [(f"'q' + {written(x)}", value("q" + value(x).strip("'"))) for x in (9, -2, 6.0, 0.5, True, False, "z")]
    hold(g, cases + [("12 + 'q'", "'12q'"), ("'x' || 'yz'", "'xyz'"), ("'x' || null", "null"), ("null + 'x'", "null"), ('"double" + \'single\'', "'doublesingle'")])


@pytest.mark.parametrize(("text", "message"), [
    ("8 % 0", r'arithmetic overflow, op: modulo, args: \["8", "0"\]'), ("-9 / 0", r"arithmetic overflow, op: divide"), ("duration('P3D') / 0", r'op: divide, args: \["P0M3DT0S0", "0"\]'),
    ("-9223372036854775807 - 2", "overflow"), ("localtime('08:00:00') - localtime('07:30:00')", "Cannot subtract LocalTime"),
    ("localdatetime('2011-03-04T05:00:00') - localdatetime('2011-03-04T04:00:00')", "Cannot subtract LocalDateTime"),
    ("datetime('2011-03-04T05:00:00+02:00') - datetime('2011-03-04T05:00:00+02:00')", "Cannot subtract ZonedDateTime"), ("localtime('noon')", "invalid argument"),
])
def test_errors_at_run_time(g, text, message):
    with pytest.raises(Exception, match=message):
        shown(g, text)


@pytest.mark.parametrize(("text", "message"), [
    ("false * 2", "Invalid argument types Bool, Integer for function multiply"), ("missing", "Variable missing is not defined"), ("frob(3)", "Unknown function frob"),
    ("lower(DISTINCT 'Q')", "DISTINCT is not allowed"), ("3 OR false", "Invalid argument types"), ("123456789012345678901", "Invalid literal"), ("-true", "unary_substract"),
])
def test_errors_of_meaning(g, text, message):
    with pytest.raises(SemanticError, match=message):
        g.cypher(f"RETURN {text}")


def test_comparison(g):
    """Numbers compare by size, values of other kinds only with their own; = and <> tell kinds apart."""
    values = (4, 4.0, -1.5, 11, "m", "n", True, False, None, [4], [4, 5])
    kind = lambda x: "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x)
    cases = []
    for a, b in itertools.product(values, values):
        alike = kind(a) == kind(b)
        for op in ("<", "<=", ">", ">=", "=", "<>"):
            if a is None or b is None:
                want = None
            elif op in ("=", "<>"):
                want = (alike and a == b) == (op == "=")
            else:
                want = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] if alike else None
            cases.append((f"{written(a) if not isinstance(a, list) else value(a)} {op} {written(b) if not isinstance(b, list) else value(b)}", value(want)))
    hold(g, cases)


def test_times_and_durations_compare_by_what_they_mean(g):
    hold(g, [
        ("date('2004-02-29') < date('2004-03-01')", "true"), ("localtime('00:00:01') > localtime('23:00:00')", "false"), ("datetime('2010-05-05T05:00:00-02:00') = datetime('2010-05-05T08:30:00+01:30')", "true"),
        ("duration('PT90S') = duration('PT1M30S')", "true"), ("0.0 % 0 = 0.0 % 0", "true"), ("3 < 4 < 5", "null"),
    ])


def test_logic(g):
    """AND with a null is null, OR with one is the other value (null: null), XOR is null."""
    truth = (True, False, None)
    cases = []
    for a, b in itertools.product(truth, truth):
        none = a is None or b is None
        results = {"AND": None if none else a and b, "OR": (a if b is None else b if a is None else a or b), "XOR": None if none else a != b}
        cases += [(f"{value(a)} {op} {value(b)}", value(x)) for op, x in results.items()]
    cases += [(f"NOT {value(a)}", value(None if a is None else not a)) for a in truth]
    cases += [(f"{written(x)} IS NULL", value(x is None)) for x in (3, "s", None)] + [(f"{written(x)} IS NOT NULL", value(x is not None)) for x in (3, "s", None)]
    hold(g, [*cases, ("false AND true OR true", "true"), ("NOT false = true", "true"), ("true XOR true AND false", "true")])


def test_logic_can_be_ansi(spark):
    ansi = GraphSession(spark, semantics="ansi")
    truth = (True, False, None)
    both = lambda a, b: False if False in (a, b) else None if None in (a, b) else True
    any_ = lambda a, b: True if True in (a, b) else None if None in (a, b) else False
    hold(ansi, [(f"{value(a)} {op} {value(b)}", value(f(a, b))) for a, b in itertools.product(truth, truth) for op, f in (("AND", both), ("OR", any_))])


def test_lists(g):
    xs = [5, 6, 7, 8]
    ends = (None, -6, -4, -1, 0, 2, 4, 9)
    cases = [(f"{xs}[{i}]", value(xs[i] if -4 <= i < 4 else None)) for i in range(-6, 7)]
    cases += [(f"{xs}[{'' if a is None else a}..{'' if b is None else b}]", value(xs[a:b])) for a, b in itertools.product(ends, ends)]
    cases += [(f"{value(x)} IN [5, 8]", value(x in (5, 8))) for x in range(4, 10)] + [("null IN [5]", "null"), ("5 IN []", "false")]
    cases += [(f"{value(x)} + {value(y)}", value((x if isinstance(x, list) else [x]) + (y if isinstance(y, list) else [y]))) for x, y in (([5], [6, 7]), ([5], 6), (5, [6]), ([], [6]))]
    cases += [(f"size({value(x)})", str(len(x))) for x in ([], [5], [5, 6], "", "quay")] + [(f"range({a}, {b})", value(list(range(a, b + 1)))) for a, b in ((2, 5), (3, 3), (-1, 1))]
    cases += [(value(x), value(x)) for x in ([], [None], [None, None], [5, None], ["p", 5, False], [5, 6.5], [[5], [6, 7]])]
    hold(g, [*cases, ("[5, 6][null]", "null"), ("[5, 6][null..1]", "[5]"), ("[6 - 1, 2 * 4]", "[5, 8]"), ("['u' + 'v']", "['uv']")])


def test_months_end_on_their_last_days(g):
    """Months are added first, the day cut to the month's last, then days are added."""
    cases = []
    for month, more in itertools.product(range(1, 13), (1, -1, 13)):
        last = calendar.monthrange(2023, month)[1]
        at = 2023 * 12 + month - 1 + more
        day = min(last, calendar.monthrange(at // 12, at % 12 + 1)[1])
        want = datetime.date(at // 12, at % 12 + 1, day)
        cases.append((f"date('2023-{month:02}-{last}') + duration('P{more}M')", str(want)))
        cases.append((f"localdatetime('2023-{month:02}-{last}T06:07:08') + duration('P{more}M2D')", f"{want + datetime.timedelta(2)} 06:07:08"))
        back = datetime.date(2023, month, last) - datetime.date(2023, 1, 1)
        cases.append((f"date('2023-{month:02}-{last}') - date('2023-01-01')", f"P0M{back.days}DT0S0"))
    hold(g, cases)


def test_clocks_go_round(g):
    cases = []
    for hour, seconds in itertools.product((0, 9, 23), (-90_000, -1, 59, 7200, 86_400)):
        turned = (datetime.datetime(2019, 6, 15, hour, 30) + datetime.timedelta(seconds=seconds)).replace(tzinfo=None)
        cases.append((f"localtime('{hour:02}:30:00') + duration('PT{seconds}S')", f"{turned:%H:%M:%S}"))
        cases.append((f"localdatetime('2019-06-15T{hour:02}:30:00') + duration('PT{seconds}S')", f"{turned:%Y-%m-%d %H:%M:%S}"))
        cases.append((f"datetime('2019-06-15T{hour:02}:30:00+04:30') + duration('PT{seconds}S')", f"{turned:%Y-%m-%d %H:%M:%S} +04:30"))
        cases.append((f"localtime('{hour:02}:30:00') - duration('PT{-seconds}S')", f"{turned:%H:%M:%S}"))
    hold(g, [*cases, ("date('2019-06-15') + duration('PT49H')", "2019-06-15"), ("duration('P2M') + date('2019-06-15')", "2019-08-15")])


def test_times_are_printed(g):
    hold(g, [
        ("date('0987-06-05')", "0987-06-05"), ("localtime('04:05:06.789')", "04:05:06.789"), ("localdatetime('1888-08-18T18:28:38.5')", "1888-08-18 18:28:38.500"),
        ("datetime('1977-07-07T17:27:37 +0245')", "1977-07-07 17:27:37 +02:45"), ("datetime('1977-07-07T17:27:37-09:00')", "1977-07-07 17:27:37 -09:00"),
        ("date(localdatetime('1977-07-07T17:27:37'))", "1977-07-07"), ("localtime(datetime('1977-07-07T17:27:37+09:00'))", "17:27:37"), ("localdatetime(datetime('1977-07-07T17:27:37+09:00'))", "1977-07-07 17:27:37"),
    ])


def test_durations(g):
    """Months, days and seconds are kept apart; a factor rounds months half away from zero."""
    shape = lambda m, d, s: f"P{m}M{d}DT{s}S0"
    away = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))
    cases = [(f"duration('P{a}M') + duration('P{b}D')", shape(a, b, 0)) for a, b in ((3, 4), (-3, 4), (0, 9))]
    cases += [(f"duration('P{a}M') - duration('PT{b}H')", shape(a, 0, -3600 * b)) for a, b in ((2, 3), (-2, 5))]
    for months, factor in itertools.product((3, -3, 5), (2, 0.5, 1.5)):
        cases.append((f"duration('P{months}M') * {factor}", shape(away(months * factor), 0, 0)))
        cases.append((f"duration('PT{months}H') * {factor}", shape(0, 0, int(3600 * months * factor))))
        cases.append((f"duration('PT{months}H') / {factor}", shape(0, 0, int(3600 * months / factor))))
    hold(g, [*cases, ("duration('P3Y1W')", shape(36, 7, 0)), ("duration('PT2.25S')", "P0M0DT2S250000000"), ("duration('PT0.7S') + duration('PT0.5S')", "P0M0DT1S200000000"), ("4 * duration('P2M')", shape(8, 0, 0))])


def test_now(g):
    row = g.cypher("RETURN date() AS d, localtime() AS t, localdatetime() AS l, datetime() AS z").first()
    assert row.d == row.l.date() and row.z.offset_s == 0 and 0 <= row.t.ns < 86_400 * 10**9


def test_other_functions(g):
    words = ("harbour", "bo", "")
    cases = [(f"'{w}' {name} '{p}'", value(f(w, p))) for w in words for p in ("ha", "our", "bo", "") for name, f in (("STARTS WITH", str.startswith), ("ENDS WITH", str.endswith), ("CONTAINS", str.__contains__))]
    cases += [(f"upper('{w}')", value(w.upper())) for w in words] + [(f"lower('{w.upper()}')", value(w)) for w in words]
    cases += [(f"toInteger('{t}')", want) for t, want in (("-41", "-41"), ("forty", "null"), ("", "null"))] + [("toFloat('-0.75')", "-0.75"), ("toString(8.0)", "'8'"), ("toString(true)", "'true'")]
    cases += [(f"CASE {x} WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END", value({1: "one", 2: "two"}.get(x, "more"))) for x in range(4)]
    cases += [(f"coalesce({', '.join(map(value, xs))})", value(next((x for x in xs if x is not None), None))) for xs in ((None, 6), (5, None), (None, None, 4))]
    cases += [(f"abs({x})", value(abs(x))) for x in (-6, 6, -0.5)] + [("sqrt(2.25)", "1.5"), ("CASE WHEN 1 > 2 THEN 'p' END", "null"), ("multiply(6, 7)", "42"), ("lt(1, 2)", "true"), ("list_index([8, 9], -1)", "9"), ("{p: 6, q: 'r'}.q", "'r'")]
    hold(g, cases)


def test_parameters_of_every_kind(g):
    given = {"whole": 8, "map": {"in": "w"}, "list": [2.5, 3.5], "day": datetime.date(2018, 9, 10), "none": None}
    assert rows_of(g.cypher("RETURN $whole AS a, $map.in AS b, $list[-1] AS c, $day AS d, $none AS e", given)) == [line(8, "w", 3.5, datetime.date(2018, 9, 10), None)]
    with pytest.raises(SemanticError, match="Parameter lost is not given"):
        g.cypher("RETURN $lost")
