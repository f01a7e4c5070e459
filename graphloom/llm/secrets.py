"""Secret scans: fixed patterns, and Markov models of random strings, in built-in functions."""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import let, sheltered

# The patterns of known secrets and the least length of a match or its value.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: The added kind: tokens of these characters that look random rather than like identifiers: of 20
#: characters or more, or of 12 or more with a digit.
RANDOM = "random"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_=-]{20,}|(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{12,})"
ALPHABET = "".join(chr(c) for c in range(ord("!"), ord("~") + 1))
#: Least log-likelihood ratio (natural logarithm) of a random token, for each of its characters and
#: in all: short tokens have to be the more unlike identifiers. Set so that of held-out labelled
#: identifiers less than one in 500 is taken for random.
PER_CHARACTER, IN_ALL = 0.35, 9.0
#: Matches whose positions are summed up at once.
BLOCK = 64

# Ordinary words of which the labelled sample of identifiers is made.
ORDINARY = """
account action active address after album amount answer append archive array attribute author average backup balance
batch before between binary block border bottom branch browser budget buffer build button cache callback campaign
cancel capture category channel character check child class client cluster column command comment commit common
company compare complete component config connect constant container content context control convert copy count
country create current customer data database date debug decode default delete delivery department description
design detail device dictionary different digest directory display document domain download driver duration dynamic
edit element email employee enable encode engine entity error event example exception execute export expression
extension factory feature field file filter final find folder following format forward frame function gateway
general generate global graph group handle handler header height history home image implement import important
include index information initial input insert instance integer interface internal invoice item iterator journal
keyboard label language latest layout length level library license limit link list listener local location logger
machine manager mapping market master matrix maximum member memory menu message method middle minimum mobile model
module monitor month namespace network normal notification number object offset operation option order organization
output package page parameter parent parser partition password path pattern payment permission person picture plugin
point policy position prefix previous price print priority private process product profile program project property
protocol provider public publish query queue random range reader record reference region register release remote
remove render repeat replace report request require reset resource response result return review role route sample
schedule schema screen script search second section secure select sender sequence server service session setting
shared simple single size source special standard start state statement static status storage stream string student
subject subscription summary support switch symbol system table target task template temporary terminal test text
thread throughput timestamp title token total tracker transaction transfer transform translate update upload user
value variable vector version video view visible volume warning window worker workflow wrapper writer
und nicht einheit keiten schaft lichkeit verwaltung entwicklung gesellschaft bundesregierung wissenschaft heit ung
schreiben durchschnitt geschwindigkeit zusammenarbeit eau tion ment que elle leur gouvernement developpement
administration universidad desarrollo informacion mente cion ado para esta trabajador conocimiento
""".split()


@lru_cache(maxsize=1)
def labelled_strings(per_kind: int = 4000, seed: int = 6) -> tuple[tuple[str, int], ...]:
    """The labelled sample: random strings of keys and digests (1) and ordinary identifiers (0)."""
    rng, rows = random.Random(seed), []
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    letters = lower + lower.upper() + digits
    alphabets = (letters, letters + "+/", letters + "-_", lower + digits, "0123456789abcdef", lower.upper() + digits)
    for k in range(per_kind):
        rows.append(("".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(12, 64))), 1))
        chosen = rng.choices(ORDINARY, k=rng.randint(2, 6))
        style = k % 9
        if style == 0:
            name = "_".join(chosen)
        elif style == 1:
            name = "-".join(chosen)
        elif style == 2:
            name = chosen[0] + "".join(w.capitalize() for w in chosen[1:])
        elif style == 3:
            name = "_".join(chosen).upper()
        elif style == 4:
            name = "/".join(chosen)
        elif style == 5:
            name = "".join(chosen)
        elif style == 6:
            name = "_".join(chosen) + "_" + str(rng.choice((rng.randint(0, 99), rng.randint(1990, 2035))))
        elif style == 7:  # numbers as people write them, with a word or not
            groups = [str(rng.randrange(10 ** rng.randint(2, 8))) for _ in range(rng.randint(2, 4))]
            name = rng.choice(("", chosen[0].upper() + "-", chosen[0] + "_", "v")) + rng.choice("-_/").join(groups)
        else:
            day = f"{rng.randint(1970, 2035)}{rng.choice(('-', '/', ''))}{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
            name = rng.choice((day, f"{chosen[0]}-{day}", f"{day}T{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}", f"{chosen[0]}{rng.randint(1, 9999)}{chosen[1]}", str(rng.randrange(10**11, 10**16))))
        rows.append((name, 0))
    rows += [(c * n, 0) for c in "=-_/+x0" for n in (20, 40, 80)]
    return tuple(rows)


def markov(strings: list[str], smoothing: float = 0.5) -> list[list[float]]:
    """Log-probabilities of a character (column) after another (row); the last row starts a string."""
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[smoothing] * n for _ in range(n + 1)]
    for s in strings:
        before = n
        for c in s:
            counts[before][at[c]] += 1
            before = at[c]
    return [[math.log(x / sum(row)) for x in row] for row in counts]


@lru_cache(maxsize=1)
def log_ratios() -> tuple[float, ...]:
    """Row by row, how much likelier a transition is in random strings than in identifiers."""
    rows = labelled_strings()
    random_, ordinary = (markov([s for s, y in rows if y == label]) for label in (1, 0))
    return tuple(round(a - b, 4) for r, o in zip(random_, ordinary, strict=True) for a, b in zip(r, o, strict=True))


def ratio(token: str) -> float:
    """The log-likelihood ratio of one token, a character."""
    table, n = log_ratios(), len(ALPHABET)
    codes = [n, *(ord(c) - ord("!") for c in token)]
    return sum(table[a * n + b] for a, b in zip(codes[:-1], codes[1:], strict=True)) / len(token)


def looks_random(token: str) -> bool:
    return ratio(token) >= PER_CHARACTER and ratio(token) * len(token) >= IN_ALL


def ratio_column(token: Column) -> Column:
    """ratio() of a token of printable ASCII, in built-in functions."""
    n = len(ALPHABET)
    table = F.expr("array(" + ",".join(f"{x}D" for x in log_ratios()) + ")")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - ord("!"))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda b, i: F.get(table, F.when(i == 0, n).otherwise(F.get(at, i - 1)) * n + b))
        return F.aggregate(steps, F.lit(0.0), lambda x, y: x + y)

    return let(codes, total) / F.char_length(token)


def _placed(text: Column, pattern: str, kind: str, keep=None, value: int = 0) -> Column:
    """Spans (start, rank, kind, end) of a pattern's matches, in code points.

    What stands between matches comes from a split, so positions are sums of lengths. A text
    without a match costs one search. keep is asked of a match, or of its group `value`.
    """
    rank = {**{k: i for i, k in enumerate(KINDS)}, RANDOM: len(KINDS)}[kind]
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")

    def of(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.transform(gaps, lambda g, i: F.struct(F.char_length(g).alias("gap"), F.coalesce(F.char_length(F.get(matches, i)), F.lit(0)).alias("own")))
        zero = F.lit(0).cast("bigint")

        def step(done: Column, piece: Column) -> Column:
            begin = done["at"] + piece["gap"]
            end = begin + piece["own"]
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

        def summed(blocks: Column) -> Column:
            """Spans block by block, so that no array grows with all of a text's matches but one number a block."""
            totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda n, piece: n + piece["gap"] + piece["own"]))
            first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all"))
            more = lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all"))
            starts = F.aggregate(totals, first, more, lambda done: done["all"])
            part = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("spans")), step, lambda done: done["spans"])
            return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: part(b, F.get(at, i)))))

        cut = lambda pieces: F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))
        spans = F.slice(let(let(lengths, cut), summed), F.lit(1), F.size(matches))
        if keep is None:
            return spans
        kept = matches if not value else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        return let(kept, lambda values: F.filter(spans, lambda s, i: keep(F.get(values, i))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), let(found, of)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The fixed kinds' spans by start, then kind: leftmost, non-overlapping within a kind."""
    # A run of hexadecimal digits, or of capitals and digits, is matched whole; so asking for the
    # length in the pattern drops the same matches. An assignment's value is measured afterwards.
    assign = _placed(text, ASSIGN, "assign", lambda v: F.char_length(v) >= ASSIGN_VALUE, 1)
    return F.array_sort(F.concat(assign, _placed(text, ACCESS, "access"), _placed(text, HEX, "hex")))


def random_spans(text: Column, base: Column) -> Column:
    """Spans of random-looking tokens: of such a token that base spans overlap, the parts that they
    leave over, each if it looks random by itself (names before an assignment or a key do not)."""
    likely = lambda token: let(ratio_column(token), lambda r: (r >= PER_CHARACTER) & (r * F.char_length(token) >= IN_ALL))
    spans = _placed(text, CANDIDATE, RANDOM, likely)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")

    def left_over(s: Column, hits: Column) -> Column:
        piece = lambda begin, end: F.array(F.struct(begin.alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), end.alias("end")))

        def step(done: Column, b: Column) -> Column:
            more = F.when(b["start"] > done["at"], piece(done["at"], b["start"])).otherwise(none)
            return F.struct(F.greatest(done["at"], b["end"]).alias("at"), F.concat(done["parts"], more).alias("parts"))

        last = lambda done: F.concat(done["parts"], F.when(done["at"] < s["end"], piece(done["at"], s["end"])).otherwise(none))
        parts = F.aggregate(hits, F.struct(s["start"].alias("at"), none.alias("parts")), step, last)
        own = lambda p: F.substring(text, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))
        return F.filter(parts, lambda p: likely(own(p)))

    def parts_of(s: Column) -> Column:
        hits = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(F.size(hits) == 0, F.array(s)).otherwise(left_over(s, hits))

    return F.when(F.size(spans) == 0, spans).otherwise(let(spans, lambda all_: F.flatten(F.transform(all_, parts_of))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and all: arrays of spans (start, rank, kind, end), sorted."""
    whole = F.coalesce(text, F.lit(""))
    found = docs.withColumn("base", base_spans(whole))
    return found.withColumn("all", F.array_sort(F.concat("base", random_spans(whole, F.col("base")))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. base_sha256 is
    of the fixed kinds' spans alone; spans holds those and the Markov models' (kind random). A null
    or empty text has no spans: three zeros, the digest of an empty string and an empty string.
    Repeated rows and null ids are rows like any other; other columns are not read. An empty table
    gives an empty one.
    """
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mask (overlapping spans by one), n_chars set anew.

    Texts without spans, null ones included, stay as they are, as do all other columns.
    """
    rows, restored = sheltered(docs)
    found = with_spans(rows, "_text")
    text = F.col("_text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        part = F.when(s["start"] >= done["at"], F.array(F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mask)))
        inside = F.array().cast("array<string>")
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["parts"], F.coalesce(part, inside)).alias("parts"))

    rest = lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))
    clean = F.when(F.size("all") == 0, text).otherwise(F.aggregate(F.col("all"), start, step, rest))
    length = F.when(F.size("all") == 0, F.col("_n_chars")).otherwise(F.char_length("_clean").cast("bigint")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("_clean"), "n_chars": length}
    return found.withColumn("_clean", clean).select(*[changed[c].alias(c) if c in changed else own for c, own in zip(docs.columns, restored, strict=True)])
