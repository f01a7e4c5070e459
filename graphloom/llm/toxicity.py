"""Toxicity: boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.boosting import BoostedTrees, isotonic
from graphloom.llm.classify import labelled_texts, score_column
from graphloom.llm.common import arrow_rows, is_held_out, materialize

#: Training texts of either label at most, those of the smallest hashes of their ids.
PER_CLASS = 4000
#: Entries of the learned lexicon at most, and toxic training texts that must hold an entry.
LEXICON = 2000
SUPPORT = 3
#: The least share of toxic training texts that hold an entry, and what is added to either share
#: before they are compared; as shares, they mean the same for samples of any size.
SUPPORT_SHARE = 0.005
SMOOTHING = 0.001
#: Lengths of the word beginnings that stand for a word's forms.
STEMS = (4, 5, 6)
THRESHOLD = 0.7
FOLDS = 4

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Words that may have letters replaced by digits or signs, the replaced letters, and words whose
#: letters stand apart.
_MIXED = re.compile(r"(?<![\w@$!*])(?:[^\W\d_]+[@$!*_0134578]|[@$013457]+[^\W\d_])[\w@$!*]*")
_MASK = re.compile(r"[@$!*_0134578]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_](?![^\W_])")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": None, "_": None})
# Words that address a reader, in the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
FEATURES = (
    "best entry", "sum of entries per word", "share of listed words", "listed words", "best two entries", "listed words near a second person",
    "second persons per word", "capitals per letter", "words in capitals", "exclamation marks", "question marks", "punctuation", "masked words", "words pulled apart", "listed masked words", "longest run of a sign", "words",
)


def stems(word: str) -> list[str]:
    """The keys under which a lexicon may list a word."""
    return [f"={word}", *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class Lexicon:
    """Log-odds of a toxic text for words (=word) and word beginnings."""

    weights: dict[str, float]

    def weight(self, word: str) -> float:
        known = self.weights
        best = known.get(f"={word}", 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, known.get(word[:n], 0.0))
        return best


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Numbers of a whole text in the order of FEATURES."""
    found = _WORD.findall(text.lower())
    n = max(1, len(found))
    counts = Counter(found)
    weight = lexicon.weight
    listed = {w: x for w in counts if (x := weight(w)) > 0}
    masked = apart = hidden = 0
    extra = 0.0
    for word in _MIXED.findall(text) if _MASK.search(text) else ():
        word = word.rstrip("!*_")
        if _MASK.search(word):
            masked += 1
            x = weight(word.lower().translate(_PLAIN))
            hidden += x > 0
            extra = max(extra, x)
    for word in _SPACED.findall(text):
        apart += 1
        x = weight(re.sub(r"[^\w]|_", "", word.lower()))
        hidden += x > 0
        extra = max(extra, x)
    total = sum(listed[w] * counts[w] for w in listed)
    times = sum(counts[w] for w in listed)
    top = sorted([*listed.values(), extra, 0.0], reverse=True)[:2]
    near = 0
    persons = sum(counts[w] for w in SECOND_PERSON if w in counts)
    if listed and persons:
        at = [i for i, w in enumerate(found) if w in SECOND_PERSON]
        where = np.array([i for i, w in enumerate(found) if w in listed])
        spot = np.searchsorted(at, where)
        gaps = np.minimum(np.abs(where - np.take(at, spot, mode="clip")), np.abs(where - np.take(at, np.maximum(spot - 1, 0), mode="clip")))
        near = int((gaps <= 5).sum())
    letters = max(1, sum(map(len, found)))
    capitals = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    loud = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    signs = len(text) - letters - text.count(" ") - text.count("\n")
    runs = max((len(m) for m in re.findall(r"[!?*$%&#]{2,}", text)), default=0)
    return [
        top[0], total / n, times / n, float(len(listed) + hidden), sum(top), float(near), persons / n, capitals / letters, loud / n,
        text.count("!") / n, text.count("?") / n, max(0, signs) / max(1, len(text)), masked / n, apart / n, float(hidden), float(runs), float(np.log1p(len(found))),
    ]


class ToxicityModel:
    """Fitted by fit(); score() is then the calibrated probability of a toxic text."""

    def __init__(self):
        self.lexicon = Lexicon({})
        self.trees = BoostedTrees(trees=40, depth=3)
        self.curve = (np.array([0.0]), np.array([0.0]))

    def fit(self, docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> ToxicityModel:
        """docs (doc_id, text), labels (doc_id, toxic); see labelled_sample for the rows used.

        A row's own label must not speak through the lexicon, so the trees see features under a
        lexicon of the sample's other folds; the isotonic curve is fitted to margins of trees that
        did not see the row either. Without labelled texts every score is 0.
        """
        arrow_rows(docs.sparkSession)
        rows = materialize(labelled_texts(docs, labels, "toxic", modulus, held_out, per_class).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)).cast("int")))
        totals = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
        if not totals:
            return self

        @F.pandas_udf("array<string>")
        def keys(texts: pd.Series) -> pd.Series:
            return pd.Series([list({k for w in set(_WORD.findall(t.lower())) for k in stems(w)}) for t in texts])

        held = rows.select("fold", "y", F.explode(keys("text")).alias("key")).groupBy("key")
        cells = [(f, y) for f in range(FOLDS) for y in (0, 1)]
        tallies = held.agg(*[F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"n{f}{y}") for f, y in cells])
        toxic = sum((F.col(f"n{f}1") for f in range(FOLDS)), F.lit(0))
        clean = sum((F.col(f"n{f}0") for f in range(FOLDS)), F.lit(0))
        likely = (toxic >= SUPPORT) & (toxic > 4 * clean)
        found = tallies.where(likely).orderBy((toxic / (clean + 1)).desc(), "key").limit(2 * LEXICON).collect()
        table = np.array([[r[f"n{f}{y}"] for f, y in cells] for r in found]).reshape(len(found), FOLDS, 2)
        sums = np.array([[totals.get((f, y), 0) for y in (0, 1)] for f in range(FOLDS)])
        names = [r.key for r in found]
        parts = [self._lexicon(names, table.sum(1) - table[:, f], sums.sum(0) - sums[f]) for f in range(FOLDS)]
        self.lexicon = self._lexicon(names, table.sum(1), sums.sum(0))

        @F.pandas_udf("array<double>")
        def numbers(texts: pd.Series, folds: pd.Series) -> pd.Series:
            return pd.Series([features(t, parts[f]) for t, f in zip(texts, folds, strict=True)])

        sample = rows.select("doc_id", "y", "fold", numbers("text", "fold").alias("x")).orderBy("doc_id", "y").collect()
        x, y = np.array([r.x for r in sample]), np.array([r.y for r in sample])
        fold = np.array([r.fold for r in sample])
        margins = np.zeros(len(y))
        for f in range(FOLDS):
            margins[fold == f] = BoostedTrees(trees=40, depth=3).fit(x[fold != f], y[fold != f]).margin(x[fold == f])
        self.trees.fit(x, y)
        self.curve = isotonic(margins, y)
        return self

    @staticmethod
    def _lexicon(names: list[str], counts: np.ndarray, totals: np.ndarray) -> Lexicon:
        share = counts / np.maximum(totals, 1)
        odds = np.log((share[:, 1] + SMOOTHING) / (share[:, 0] + SMOOTHING))
        least = max(SUPPORT - 1, SUPPORT_SHARE * totals[1])
        keep = [i for i in np.argsort(-odds, kind="stable") if odds[i] > 1 and counts[i, 1] >= least][:LEXICON]
        return Lexicon({names[i]: float(odds[i]) for i in keep})

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.interp(self.trees.margin(x), *self.curve)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    score is the probability that a text is toxic, from its whole text alone; predicted is 1 from
    THRESHOLD on. Null and empty texts are scored like any other (no words, so unlikely toxic).
    Rows with a null label, and labels without a document, teach nothing; a doc_id labelled both
    ways counts as toxic. Repeated rows and null ids are scored like others. Other columns are not
    read. An empty table gives an empty one.
    """
    arrow_rows(docs.sparkSession)
    model = ToxicityModel().fit(docs, labels)
    scored = docs.select("doc_id", is_held_out(3, 1).alias("held_out"), score_column(F.col("text"), model.score).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
