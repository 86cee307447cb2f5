"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document of label 1 over one of label 0) train a linear
score by logistic loss on feature differences; a text is accepted when its
score reaches a quantile of the training scores, the share of label 0.  The
reported score is a logistic curve through that quantile at ``CUT``.

The model is fitted on the driver from at most ``max_labelled`` labelled rows
(those with the smallest hash of the id, a bound that is a parameter); every
row is then scored.  Only the text is a feature.

Nulls and edge cases: null, blank and empty texts have the features of an
empty text and get a score; labels that are null, or that contradict each other
for an id, teach nothing; with no pair to learn from every score is 0.5.
Repeated rows are scored each; of a repeated id with different texts the one of
the least features teaches.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.llm import common

MAX_LABELLED = 8_000
PAIRS = 60_000
CUT = 0.3
_WORD = re.compile(r"\S+")
FEATURES = (
    "words", "mean_length", "long_words", "letters", "digits", "upper_words", "upper_letters", "marks", "odd_marks", "bars",
    "distinct", "repeats", "top_word", "stop_short", "commas", "stops", "double_marks", "lines", "repeated_lines", "non_ascii",
    "zip_ratio", "empty",
)


def features(text: str | None) -> list[float]:
    """Shape of a whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    chars = max(1, sum(map(len, words)))
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high = count[128:].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    odd = sum(int(count[ord(c)]) for c in "#$%&*+<=>@\\^_`{}~!")
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
    kinds = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    shouted = sum(map(str.isupper, words))
    return [
        np.log1p(n), chars / n, float((lengths > 15).mean()), (upper + lower + high) / size, digits / size, shouted / n, upper / size,
        marks / size, odd / size, count[124] / n, len(kinds) / n, repeats / n, max(kinds.values()) / n, float((lengths <= 3).mean()),
        count[44] / n, count[46] / n, text.count("!!") / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), high / size,
        len(zlib.compress(raw, 1)) / size, 0.0,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised features and their squares: a text can be odd on either side of usual."""
    x = np.clip(x, -6, 6)
    return np.hstack([x, x * x / 6])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pivot: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.pivot) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> Model | None:
    """Newton steps on the pairwise logistic loss; None when one label is missing."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    z = expand((x - mean) / scale)
    d = z[good[rng.integers(0, len(good), pairs)]] - z[bad[rng.integers(0, len(bad), pairs)]]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0, 1.0)
    raw = model.raw(x)
    model.pivot = float(np.quantile(raw, len(bad) / len(label)))
    model.slope = float(2.0 / max(1e-6, np.median(raw[good]) - np.median(raw[bad]))) * 2
    return model


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids (by CRC-32 of the id as text) whose labels are never learned."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED) -> Model | None:
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_most"))
        .where("_label = _most").select("_id", "_label")
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(known), "_id")  # max_labelled rows at most
    )
    kinds = f"id long, label int, x array<double>"

    def sheet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["_id"], "label": b["_label"], "x": list(matrix(b["_text"]))})
        common.trim()

    got = rows.mapInPandas(sheet, kinds).toPandas()
    if got.empty:
        return None
    got = got.assign(_order=got["x"].map(tuple)).sort_values(["id", "_order"]).drop_duplicates("id")  # of repeated ids the same row whatever the order
    return fit(np.stack(got["x"].to_numpy()), got["label"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **how) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted (they replace columns of the same name)."""
    common.bound_batches(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    kept = docs.select(*[c for c in docs.columns if c not in ("held_out", "score", "predicted")])

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.score(matrix(texts)) if model else np.full(len(texts), 0.5))
        common.trim()

    return kept.withColumns({"held_out": held_out(id_col), "score": score(F.col(text_col))}).withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )
