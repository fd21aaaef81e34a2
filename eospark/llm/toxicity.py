"""Toxicity scores from a counterfactual-regularised linear classifier.

Training sentences that name a group of people are paired with a copy that names another group of the same kind, and
score differences within a pair are penalised, so that the mention of a group does not count as toxic by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows of either label are fitted; they are taken in the order of a hash of the id.
MAX_ROWS_EACH = 3000
#: Features are hashed to so many places; of those, at most MAX_FEATURES with the clearest difference are fitted.
SPACE, MAX_FEATURES, MIN_Z = 1 << 20, 1500, 3.0
STEPS = 300
THRESHOLD = 0.3
CACHE_WORDS = 400_000
_EDGES = ".,;:!?\"'()[]{}*%&$#|<>-_«»¿¡"

#: Words that name groups; each line holds words that may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("deaf", "blind", "disabled", "hearing"),
    ("old", "young"),
    ("femmes", "hommes"),
    ("musulman", "chrétien", "juif"),
    ("frauen", "männer"),
    ("muslimisch", "christlich", "jüdisch"),
    ("mujeres", "hombres"),
    ("musulmán", "cristiano", "judío"),
)
_SWAP = {w: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, w in enumerate(group)}


def word_features(token: str) -> tuple[int, ...]:
    """Hashed features of one lower-cased token: the word, and how it begins."""
    word = token.strip(_EDGES)
    if not word:
        return ()
    parts = {"w" + word} | {f"p{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n}
    return tuple(xxhash.xxh32_intdigest(p) % SPACE for p in parts)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of a whole text and how many different tokens have them."""
    found = [f for t in set((text or "").lower().split()) for f in word_features(t)]
    return np.unique(np.array(found, np.int32), return_counts=True)


def swapped(text: str | None) -> str | None:
    """The text with each identity term replaced by another of its kind; none if it has no such term."""
    words = (text or "").lower().split()
    new = [w.replace(c, _SWAP[c]) if (c := w.strip(_EDGES)) in _SWAP else w for w in words]
    return None if new == words else " ".join(new)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]], prior: float, swap_weight: float = 5.0) -> dict:
    """Weights by feature, and a bias, from (label, features, counts, the same of the swapped text) rows.

    ``prior`` is the share of label 1 among all rows that could have been taken. Without rows of both labels every text
    gets the prior as its score.
    """
    label = np.array([r[0] for r in rows], np.float64)
    base = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    if not 0 < label.sum() < len(label):
        return {"weights": {}, "bias": base}
    share = label.mean()
    df = np.zeros((2, SPACE))
    for r in rows:
        df[r[0], r[1]] += 1
    n1, n0 = label.sum(), len(label) - label.sum()
    p = (df[1] + df[0]) / len(label)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[df.sum(axis=0) < 5] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:MAX_FEATURES]
    chosen = chosen[np.abs(z[chosen]) > MIN_Z]
    named = [f for w in _SWAP for f in word_features(w) if df[:, f].any()]
    chosen = np.unique(np.concatenate([chosen, np.array(named, np.int64)]).astype(np.int64))
    place = np.full(SPACE, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(pairs), len(chosen)), np.float32)
        for i, (f, c) in enumerate(pairs):
            at = place[f]
            x[i, at[at >= 0]] = c[at >= 0]
        return x

    x = matrix([(r[1], r[2]) for r in rows])
    both = [r for r in rows if r[3] is not None]
    change = matrix([(r[3], r[4]) for r in both]) - matrix([(r[1], r[2]) for r in both]) if both else np.zeros((0, len(chosen)), np.float32)
    w, b = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = x.T @ (s - label) / len(label) + 1e-4 * w
        if len(change):
            g += swap_weight * change.T @ (change @ w) / len(change)
        g = np.append(g, (s - label).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    # The rows were taken by label; the bias goes back to the share of toxic rows among all.
    bias = b - float(np.log(share / (1 - share))) + base
    return {"weights": {int(f): float(x) for f, x in zip(chosen, w, strict=True) if x}, "bias": bias}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows_each: int = MAX_ROWS_EACH) -> dict:
    """Fit on at most ``max_rows_each`` labelled documents of either label (``labels``: id, ``toxic`` 0 or 1).

    Rows without id, label or document are left out; of several labels for an id the larger counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return {"weights": {}, "bias": float("-inf")}
    order = [F.xxhash64("_id"), F.col("_id")]
    taken = [known.where(F.col("toxic") == y).orderBy(*order).limit(max_rows_each) for y in (0, 1)]
    taken = F.broadcast(taken[0].unionByName(taken[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [text_features(t) for t in texts]
            other = [text_features(s) if (s := swapped(t)) is not None else None for t in texts]
            cols = [batch.column(0)] + [pa.array([x[i].astype(np.int32) for x in own], ints) for i in (0, 1)]
            cols += [pa.array([None if x is None else x[i].astype(np.int32) for x in other], ints) for i in (0, 1)]
            yield pa.record_batch(cols, ["toxic", "f", "n", "sf", "sn"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(taken, "_id").select(F.col("toxic").cast("int"), "text")
    got = src.mapInArrow(run, "toxic int, f array<int>, n array<int>, sf array<int>, sn array<int>").toArrow()
    cols = [got.column(i).combine_chunks() for i in range(5)]
    as_np = lambda a, i: None if not a[i].is_valid else a[i].values.to_numpy(zero_copy_only=False)
    rows = [(cols[0][i].as_py(), *(as_np(c, i) for c in cols[1:])) for i in range(got.num_rows)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit(rows, float(share))


class _Weights(dict):
    """The summed weight of each token; made once a task, and started anew when it holds too many."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        self[token] = x = sum(self.weights.get(f, 0.0) for f in word_features(token))
        return x

    def scores(self, texts, bias: float) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        # Exact sums, so that the order of a set's tokens does not matter.
        sums = [math.fsum(map(self.__getitem__, set((t or "").lower().split()))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64) + bias, -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: from 0 to 1, of every whole text; null and empty texts get the score of no words at all.

    Rows are scored where they are: repeated rows and null ids are rows of their own, a text of any length is scored whole, an
    empty table gives an empty table and other columns are ignored. Without labels the score is 0; without a usable word in
    the labelled texts it is the share of toxic labels.
    """
    weights, bias = model["weights"], model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(weights)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(known.scores(batch.column(1).to_pylist(), bias))], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def held_out(key):
    """The quarter of the documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, and nothing moves.

    Where no model can be fitted, as there are no labels or no usable words in the labelled texts, all rows are kept. Null and
    empty texts, repeated rows, null ids, very long texts and empty tables: as in ``score``.
    """
    model = train(docs, labels, id_col, text_col)
    if not model["weights"]:
        return docs
    weights, bias = model["weights"], model["bias"]

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Weights(weights)
        for texts in batches:
            yield pd.Series(known.scores(texts, bias), dtype="float64")

    return docs.where(toxic(F.col(text_col).cast("string")) < threshold)
