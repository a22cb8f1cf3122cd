"""Quality classifier: random Fourier features of document statistics, ridge regression by normal equations, isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fold
from pairloom.session import pinned

FEATURES = (
    "words", "chars", "mean_length", "length_spread", "distinct", "adjacent_repeats", "top_share", "letters", "digits", "upper", "space", "stops", "symbols",
    "symbol_words", "one_letter", "long_words", "lines", "line_repeats", "line_length", "pair_distinct", "bars",
)
WIDTH = 256
SEED = 5
RIDGE = 1.0
#: Kernel width in units of standardised features: exp(-|x - y|^2 / (2 * SCALE^2)).
SCALE = 4.0
#: Ridge scores are calibrated in steps of 1 / STEPS between -1 and 2.
STEPS = 1000
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")


def statistics(text: str | None) -> np.ndarray:
    """Statistics of the whole text; an empty or null text has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    chars = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(str.isalpha, text)) if chars < 0 else len(re.findall(r"[^\W\d_]", text))
    symbols = len(_SYMBOL.findall(text))
    return np.array([
        np.log1p(n), np.log1p(chars), lengths.mean(), lengths.std(), len(counts) / n, sum(map(str.__eq__, words, words[1:])) / n, max(counts.values()) / n,
        letters / chars, sum(map(text.count, "0123456789")) / chars, sum(w[0].isupper() for w in words) / n, text.count(" ") / chars, sum(map(text.count, ".!?")) / n, symbols / chars,
        sum(map(words.count, "|#*&")) / n, float((lengths == 1).mean()), float((lengths > 20).mean()), np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(chars / max(1, len(lines))), len(set(zip(words, words[1:]))) / n, text.count("|") / n,
    ])


@dataclass
class Model:
    """Standardisation, random projection, ridge weights and the calibration steps. ``weights`` None: nothing was learnt."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lifted((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; 0.5 where nothing was learnt."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0, 1)


def lifted(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics (clipped at 6 spreads), with a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / SCALE, (len(FEATURES), WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH)
    z = np.clip(z, -6, 6)
    return np.hstack([np.sqrt(2 / WIDTH) * np.cos(z @ w + b), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of sorted bins by pooling adjacent violators."""
    pools: list[list[float]] = []
    for at, t, c in zip(x, total, count):
        pools.append([at, at, t, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            low, high = pools[-2], pools.pop()
            low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
    steps = np.array([e for p in pools for e in (p[0], p[1] + 1e-9)])
    return steps, np.repeat([p[2] / p[3] for p in pools], 2)


def with_statistics(docs: DataFrame, name: str = "_stats") -> DataFrame:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn(name, stats(F.col("text")))


def fit(labelled: DataFrame) -> Model:
    """(doc_id, _stats, label 0/1) -> model. Four fifths of the rows (by id) give the ridge weights, the rest the calibration.

    Each partition adds up its own normal equations (257 x 257); the driver adds one such sum a slot, 16 in all.
    """
    rows = labelled.withColumn("_calibrates", F.coalesce(F.xxhash64(F.lit(SEED), "doc_id") % 5 == 0, F.lit(False)))
    k = len(FEATURES)
    moments = rows.filter(~F.col("_calibrates")).agg(*[f(F.col("_stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    empty = Model(np.zeros(k), np.ones(k), None, np.zeros(1), np.full(1, 0.5))
    if moments[0] is None:
        return empty
    mean, spread = np.array(moments[0::2], float), np.array(moments[1::2], float)
    spread[spread < 1e-9] = 1.0
    d = WIDTH + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, n = np.zeros((d, d + 1)), 0
        for pdf in batches:
            if len(pdf):
                z = lifted((np.stack(pdf["_stats"].to_numpy()) - mean) / spread)
                a[:, :d] += z.T @ z
                a[:, d] += z.T @ pdf["label"].to_numpy(float)
                n += len(pdf)
        if n:
            yield pd.DataFrame({"slot": [int(np.random.default_rng().integers(16))], "sums": [a.ravel()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": pdf["slot"][:1], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

    partial = rows.filter(~F.col("_calibrates")).select("_stats", "label").mapInPandas(sums, "slot int, sums array<double>")
    total = sum(np.array(r["sums"]).reshape(d, d + 1) for r in partial.groupBy("slot").applyInPandas(added, "slot int, sums array<double>").toLocalIterator())
    weights = np.linalg.solve(total[:, :d] + RIDGE * np.diag([1.0] * WIDTH + [1e-6]), total[:, d])
    model = Model(mean, spread, weights, np.zeros(1), np.zeros(1))

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(np.round(np.clip(model.raw(np.stack(stats.to_numpy())), -1, 2) * STEPS) / STEPS) if len(stats) else pd.Series([], dtype=float)

    bins = rows.filter("_calibrates").select(raw("_stats").alias("x"), "label").groupBy("x").agg(F.sum("label").alias("t"), F.count("*").alias("c")).orderBy("x").collect()
    if not bins:  # as good as uncalibrated
        return Model(mean, spread, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    steps, values = isotonic(*(np.array([float(b[i]) for b in bins]) for i in range(3)))
    return Model(mean, spread, weights, steps, values)


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """(doc_id, _stats) -> model of ``labels.quality`` from documents whose crc32(doc_id as text) mod 5 is not 0. Rows with a null id
    or label, and labels of unknown documents, are passed over. Statistics, not texts, meet the labels."""
    known = labels.filter("quality is not null").select("doc_id", F.col("quality").alias("label"))
    own = stats.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "_stats").join(known, "doc_id")
    return fit(pinned(own.select("doc_id", "_stats", "label")))


def _score(model: Model, stats: Column) -> Column:
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_numpy()))) if len(rows) else pd.Series([], dtype=float)

    return score(stats)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of calibrated scores of its texts; other columns stay."""
    return with_statistics(docs, "_stats").withColumn(name, _score(model, F.col("_stats"))).drop("_stats")


#: From this score on a document counts as good.
THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, ...), (doc_id, quality, ...) -> (doc_id, held_out, score, predicted).

    Null and empty texts have the score of a text whose statistics are all zero. Repeated rows come back as often as they came; a
    null id is never held out and never learnt from. Without labels every score is 0.5.
    """
    stats = pinned(with_statistics(docs.select("doc_id", "text")).select("doc_id", "_stats"))
    out = stats.withColumn("score", _score(learn(stats, labels), F.col("_stats")))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
