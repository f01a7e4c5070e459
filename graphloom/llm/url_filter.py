"""URL filters: host rules, and boosted trees on lexical features, in built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.boosting import BoostedTrees

#: Labelled URLs that the trees are fitted on at most: those of the smallest hashes.
SAMPLE_ROWS = 20_000
#: Rows from which on a suffix or a path head has a statistic of its own; the others share the mean.
SUPPORT = 50
#: Strength of the mean in a statistic, in rows.
PRIOR_ROWS = 10


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(F.split(text, "")), share)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.filter(terms, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers of a URL's text; null counts as empty, so none is ever null."""
    text = F.coalesce(url, F.lit(""))
    n = F.char_length(text)
    count = lambda of, pattern: F.size(F.regexp_extract_all(of, F.lit(pattern), F.lit(0))).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": n.cast("double"),
        "host_length": F.char_length(host).cast("double"),
        "depth": count(path, "[^/]+"),
        "labels": count(host, r"[^.]+"),
        "digit_ratio": count(text, "[0-9]") / F.greatest(n, F.lit(1)),
        "host_digit_ratio": count(host, "[0-9]") / F.greatest(F.char_length(host), F.lit(1)),
        "hyphens": count(host, "-"),
        "entropy": _entropy(text),
        "host_entropy": _entropy(host),
        "parameters": count(query, "[^&]+"),
        "secure": text.startswith("https://").cast("double"),
        "extension": F.rlike(path, F.lit(r"\.[A-Za-z0-9]+$")).cast("double"),
    }


def _keys(host: Column, path: Column) -> dict[str, Column]:
    """The suffix and the path head, whose shares of blocked URLs are features."""
    return {"suffix": F.substring_index(host, ".", -1), "head": F.regexp_extract(path, "^/([^/]*)", 1)}


#: Words of visible text for each link: pages of fewer are labelled as to be blocked, of more as to be
#: allowed; those between have no label.
SPARSE, RICH = 15, 30


def page_labels(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(url, verdict) of a sample of pages (page_id, url, html), labelled by what the pages hold.

    Such pages as link farms hold little text for their links; that is all these labels say. They are
    read from the page, never from its address, so the trees cannot learn the rule itself: only
    whether addresses tell such pages. About sample_rows rows are labelled, of the smallest hashes of
    page_id and url; pages without a URL or a content have no label.
    """
    if "html" not in pages.columns:
        return pages.select("url", F.lit(None).cast("string").alias("verdict")).limit(0)
    every = max(1, pages.count() // sample_rows)
    rows = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0))
    hidden = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
    count = lambda of, pattern: F.size(F.regexp_extract_all(of, F.lit(pattern), F.lit(0)))
    words, links = count(F.regexp_replace("html", hidden, " "), r"\S+"), count(F.col("html"), r"(?i)<a\s")
    share = words / (links + 1)
    verdict = F.when(share < SPARSE, "block").when(share >= RICH, "allow")
    return rows.select("url", verdict.alias("verdict")).where("verdict is not null")


class UrlModel:
    """Boosted trees on lexical features and on suffix statistics of labelled URLs."""

    def __init__(self, trees: int = 30, depth: int = 4):
        self.trees = BoostedTrees(trees=trees, depth=depth, rate=0.3)
        self.shares: dict[str, dict[str, float]] = {}
        self.mean = 0.5
        self.known = False  # whether there were labels

    def fit(self, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
        """labelled: url and verdict (allow or block). Rows of other verdicts are left out.

        At most sample_rows rows, of the smallest hashes of their URLs, reach the driver, as numbers and
        short keys. Statistics that a row's own label is part of would leak it, so the trees see
        shares counted on the other half of the hosts. A quarter of the hosts is held out: so many
        trees are kept as serve it best, none if addresses tell nothing of other hosts' labels.
        """
        rows = labelled.where(F.col("verdict").isin("allow", "block")).select("url", (F.col("verdict") == "block").cast("int").alias("y"))
        rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(sample_rows)
        host, path = host_of(F.col("url")), path_of(F.col("url"))
        keys = _keys(host, path)
        numbers = F.array(*lexical_features(F.col("url"), host, path).values())
        found = rows.select("y", numbers.alias("x"), *[v.alias(k) for k, v in keys.items()], F.pmod(F.xxhash64(F.lit(7), host), F.lit(8)).cast("int").alias("fold")).collect()
        if not found:
            return self
        y, fold = np.array([r.y for r in found]), np.array([r.fold for r in found])
        half, held = fold % 2, fold >= 6
        x = np.array([r.x for r in found]).reshape(len(found), -1)
        self.known = True
        self.mean = float((y.sum() + 1) / (len(y) + 2))
        extra = []
        for k in keys:
            values = np.array([r[k] for r in found], object)
            self.shares[k] = self._share(values, y)
            halves = [self._share(values[half != h], y[half != h]) for h in (0, 1)]
            extra.append([halves[h].get(v, self.mean) for v, h in zip(values, half, strict=True)])
        x = np.column_stack([x, *extra])
        self.trees.fit(x[~held], y[~held])
        if held.any():
            losses = [np.logaddexp(0, np.where(y[held] == 1, -m, m)).mean() for m in self.trees.margins(x[held])]
            del self.trees.fitted[int(np.argmin(losses)) :]
        return self

    def _share(self, values: np.ndarray, y: np.ndarray) -> dict[str, float]:
        if not len(values):
            return {}
        names, at, n = np.unique(values.astype(str), return_inverse=True, return_counts=True)
        blocked = np.bincount(at, y, len(names))
        return {str(names[i]): float((blocked[i] + PRIOR_ROWS * self.mean) / (n[i] + PRIOR_ROWS)) for i in np.flatnonzero(n >= SUPPORT)}

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (url, host, path and others) with __score, the probability of a block."""
        features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
        for k, key in _keys(F.col("host"), F.col("path")).items():
            shares = self.shares.get(k, {})
            found = F.lit(self.mean)
            if shares:
                table = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])
                found = F.coalesce(F.try_element_at(table, key), F.lit(self.mean))
            features[f"share_{k}"] = found
        named = rows.withColumns({f"__x{i}": f for i, f in enumerate(features.values())})
        margin = self.trees.margin_column([F.col(f"__x{i}") for i in range(len(features))])
        return named.withColumn("__score", 1 / (1 + F.exp(-margin))).drop(*[f"__x{i}" for i in range(len(features))])


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of pages (page_id, url, html).

    A URL that a rule fits gets the longest rule's verdict; any other is blocked if the trees give
    a block a probability of one half or more. The trees are fitted on labelled (url, verdict), by
    default on page_labels(); without labelled URLs all others are allowed. A null URL, or one
    without ://, has an empty host and path, fits no rule and is judged by the trees like any other.
    Very long URLs are read whole. Repeated rows and null ids stay. Other columns are not read. An
    empty table gives an empty one.
    """
    rows = pages.select("page_id", "url")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    model = UrlModel().fit(page_labels(pages) if labelled is None else labelled)
    scored = model.score(rows)
    by_score = F.when(F.col("__score") >= 0.5, "block").otherwise("allow") if model.known else F.lit("allow")
    return scored.select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), by_score).alias("verdict"), F.col("__score").alias("block_score"),
    )
