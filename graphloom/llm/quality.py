"""Quality: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.classify import labelled_texts, score_column
from graphloom.llm.common import arrow_rows, is_held_out, materialize, sheltered

#: Training texts of either label at most, those of the smallest hashes of their ids.
PER_CLASS = 3000
#: Hashed word features, bins of each statistic, and factors of an interaction.
HASHED = 1 << 13
BINS = 16
FACTORS = 6
THRESHOLD = 0.7

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()\-]")
STATISTICS = (
    "characters", "words", "word length", "different words", "commonest word", "repeated neighbours", "symbols", "capitals", "words in capitals",
    "digits", "full stops", "lines", "repeated lines", "line length", "longest run", "words with symbols", "bars",
)


def statistics(text: str, found: list[str], counts: Counter) -> list[float]:
    """Structure and size of a whole text, in the order of STATISTICS."""
    n, size = max(1, len(found)), max(1, len(text))
    lines = text.split("\n")
    same = sum(1 for a, b in zip(found, found[1:], strict=False) if a == b)
    symbols = _SYMBOLS.findall(text)
    return [
        np.log1p(len(text)), np.log1p(len(found)), sum(map(len, found)) / n, len(counts) / n, max(counts.values(), default=0) / n, same / n,
        len(symbols) / size, (sum(map(str.isupper, text)) if text != text.lower() else 0) / size, sum(1 for w in found if len(w) > 1 and w.isupper()) / n,
        sum(map(str.isdigit, text)) / size, text.count(".") / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)),
        max(map(len, found), default=0), sum(1 for w in counts if _SYMBOLS.search(w)) / max(1, len(counts)), text.count("|") / n,
    ]


_hashes: dict[str, int] = {}


def _hashed(word: str) -> int:
    """A word's feature; the words seen are kept, up to a bound."""
    at = _hashes.get(word)
    if at is None:
        if len(_hashes) >= 1 << 17:
            _hashes.clear()
        at = _hashes[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED
    return at


def raw_features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their weights (the text's have unit length), and the statistics."""
    found = text.split()
    counts = Counter(found)
    at = np.fromiter((_hashed(w.lower()) for w in counts), np.int64, len(counts))
    weight = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return at, weight / max(1e-9, np.sqrt((weight**2).sum())), statistics(text, found, counts)


class FactorisationMachine:
    """Log-odds w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j.

    The pairs are summed in linear time: half of (sum v_i x_i)^2 - sum (v_i x_i)^2, for each factor.
    """

    def __init__(self, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 3):
        self.epochs, self.rate, self.decay, self.seed = epochs, rate, decay, seed
        self.cuts = np.zeros((len(STATISTICS), BINS - 1))
        size = HASHED + len(STATISTICS) * BINS
        self.bias, self.w, self.v = 0.0, np.zeros(size), np.zeros((size, FACTORS))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, list[float]]], y: np.ndarray) -> FactorisationMachine:
        """Adagrad over minibatches in a fixed order; without rows every score is even odds."""
        if not rows:
            return self
        stats = np.array([r[2] for r in rows])
        self.cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        rng = np.random.default_rng(self.seed)
        self.v = rng.normal(0, 0.05, self.v.shape)
        self.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        gw, gv, gb = np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(self.epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                at, x, starts = self._flat([rows[i] for i in part])
                margin, sums = self._margin(at, x, starts)
                error = (1 / (1 + np.exp(-margin)) - y[part]) / len(part) * 8
                row = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(at))))
                e = error[row] * x
                dv = e[:, None] * (sums[row] - self.v[at] * x[:, None])
                names, where = np.unique(at, return_inverse=True)
                dw = np.bincount(where, e, len(names)) + self.decay * self.w[names]
                dvs = np.stack([np.bincount(where, dv[:, k], len(names)) for k in range(FACTORS)], 1) + self.decay * self.v[names]
                gw[names] += dw**2
                gv[names] += dvs**2
                gb += error.sum() ** 2
                self.w[names] -= self.rate * dw / np.sqrt(gw[names])
                self.v[names] -= self.rate * dvs / np.sqrt(gv[names])
                self.bias -= self.rate * error.sum() / np.sqrt(gb)
        return self

    def _flat(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of some rows one after the other: positions, values, starts of rows.

        A statistic is the one of its bins that it falls into.
        """
        stats = np.array([r[2] for r in rows])
        bins = np.stack([np.searchsorted(c, s, "left") for c, s in zip(self.cuts, stats.T, strict=True)], 1)
        dense = HASHED + np.arange(len(STATISTICS)) * BINS + bins
        own = np.full(len(STATISTICS), 1 / np.sqrt(len(STATISTICS)))
        at = np.concatenate([a for r, d in zip(rows, dense, strict=True) for a in (d, r[0])])
        x = np.concatenate([a for r in rows for a in (own, r[1])])
        lengths = np.array([len(r[0]) + len(STATISTICS) for r in rows])
        return at, x, np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def _margin(self, at, x, starts) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return self.bias + np.add.reduceat(self.w[at] * x, starts) + pairs, sums

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin, _ = self._margin(*self._flat([raw_features(t) for t in texts]))
        return 1 / (1 + np.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> FactorisationMachine:
    """The machine fitted to docs (doc_id, text) and labels (doc_id, quality); see labelled_sample."""
    arrow_rows(docs.sparkSession)
    schema = "y int, id bigint, at array<int>, x array<double>, stats array<double>"

    def extracted(batches):
        for rows in batches:
            found = [raw_features(t) for t in rows["text"]]
            yield pd.DataFrame({"y": rows["y"], "id": rows["doc_id"], "at": [f[0].astype(np.int32) for f in found], "x": [f[1] for f in found], "stats": [f[2] for f in found]})

    texts = labelled_texts(docs, labels, "quality", modulus, held_out, per_class).select(F.col("doc_id").cast("bigint"), "text", "y")
    sample = materialize(texts.mapInPandas(extracted, schema)).orderBy("id", "y", "stats").toLocalIterator()
    rows, y = [], []
    for r in sample:
        rows.append((np.array(r.at, np.int64), np.array(r.x), list(r.stats)))
        y.append(r.y)
    return FactorisationMachine().fit(rows, np.array(y))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    score is the probability of good quality, from the whole text alone; predicted is 1 from
    THRESHOLD on. Null and empty texts are scored from their (zero) statistics. Rows with a null
    label, and labels without a document, teach nothing; a doc_id labelled both ways counts as
    good. Repeated rows and null ids are scored like others. Other columns are not read. An empty
    table gives an empty one; without labels every score is one half.
    """
    model = fit_quality(docs, labels)
    scored = docs.select("doc_id", is_held_out(4, 2).alias("held_out"), score_column(F.col("text"), model.score).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the machine does not reject, in their own columns."""
    model = fit_quality(docs, labels)
    rows, restored = sheltered(docs)
    scored = rows.withColumn("_quality", score_column(F.col("_text"), model.score))
    return scored.where(F.col("_quality") >= threshold).select(*restored)
