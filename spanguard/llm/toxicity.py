"""Toxicity by a classifier chain of linear models over word presence.

Categories are predicted one after the other; each model also sees the log-odds of the earlier categories,
which for training come from models that have not seen the row (out of fold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column, map_arrow, parts, table, text_slices
from .words import split_words

#: Bounds of the training sample: about so many labelled rows with each combination of labels, of texts of so
#: many bytes at most; folds; the words that a model keeps at most.
SAMPLE, SAMPLE_TEXT_BYTES, FOLDS, MOST_WORDS = 1500, 1 << 16, 5, 1500
#: Different texts of the sample that a word has to occur in to be a feature; standard deviations by which its
#: share of positives has to differ from chance.
LEAST_ROWS, LEAST_SCORE = 4, 5.0
#: Probability from which a row counts as positive; held-out rows without the label hardly come near it.
THRESHOLD = 0.3


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of each distinct word of each text."""
    rows, words = [], []
    for first, _, raw, offsets in text_slices(column):
        w = split_words(raw, offsets)
        order = np.lexsort((w.hash, w.row))
        r, h = w.row[order], w.hash[order]
        new = np.ones(r.size, dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        rows.append(r[new] + first)
        words.append(h[new])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty.astype(np.uint64), *words])


@dataclass
class Linear:
    """Logistic model: sorted word hashes, their weights, weights of the earlier categories, bias."""

    words: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def log_odds(self, n: int, row: np.ndarray, word: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias)
        if self.words.size and word.size:
            at = np.minimum(np.searchsorted(self.words, word), self.words.size - 1)
            hit = self.words[at] == word
            z += np.bincount(row[hit], weights=self.weights[at[hit]], minlength=n)
        return z + earlier @ self.chain


def fit_linear(n: int, row: np.ndarray, word: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.1) -> Linear:
    """Keep the words that tell most, then fit by gradient steps on the sparse presence; weight restores the population."""
    found, at = np.unique(word, return_inverse=True)
    df = np.bincount(at, minlength=found.size).astype(float)
    pos = np.bincount(at, weights=y[row], minlength=found.size)
    p = y.mean() if n else 0.0
    score = np.abs(pos - df * p) / np.sqrt(np.maximum(df * p * (1 - p), 1e-9))
    score[df < LEAST_ROWS] = 0
    best = np.argsort(-score, kind="stable")[:MOST_WORDS]
    best = np.sort(best[score[best] > LEAST_SCORE])
    place = np.full(found.size, -1)
    place[best] = np.arange(best.size)
    kept = place[at] >= 0
    row, col = row[kept], place[at[kept]]
    w, chain, bias = np.zeros(best.size), np.zeros(earlier.shape[1]), 0.0
    weight = weight / max(weight.mean(), 1e-12) / max(n, 1)
    m = v = np.zeros(best.size + chain.size + 1)
    for step in range(1, 401):
        z = np.bincount(row, weights=w[col], minlength=n) + earlier @ chain + bias
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(col, weights=r[row], minlength=best.size) + l2 * w / max(n, 1), earlier.T @ r + l2 * chain / max(n, 1), [r.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, chain, bias = w - move[: w.size], chain - move[w.size : -1], bias - move[-1]
    return Linear(found[best], w, chain, float(bias))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """texts x categories."""
        n = len(column)
        row, word = presence(column)
        odds = np.zeros((n, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.log_odds(n, row, word, odds), -30, 30)])
        return 1 / (1 + np.exp(-odds))


def fit_chain(texts: list[str | None], labels: np.ndarray, weight: np.ndarray, categories: list[str], folds: int = FOLDS) -> Chain:
    """labels: texts x categories, 0 or 1. Rows are dealt to folds in turn."""
    n = len(texts)
    row, word = presence(pa.array(texts, pa.large_string()))
    fold = np.arange(n) % folds
    odds, models = np.zeros((n, 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        out = np.zeros(n)
        for f in range(folds):
            here = fold != f
            number = np.cumsum(here) - 1
            mine = here[row]
            model = fit_linear(int(here.sum()), number[row[mine]], word[mine], odds[here], y[here], weight[here])
            out[~here] = model.log_odds(n, row, word, odds)[~here]
        models.append(fit_linear(n, row, word, odds, y, weight))
        odds = np.column_stack([odds, np.clip(out, -30, 30)])
    return Chain(categories, models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit a chain on a bounded sample of labelled rows.

    categories: name -> SQL condition over labels, in the order of the chain. Of each combination of
    conditions about `sample` rows are drawn by a hash of the id, or all if there are fewer; weights restore
    their shares. Rows with null ids, texts or labels, and texts of over SAMPLE_TEXT_BYTES, aren't used; of rows
    that repeat an id or a text the one with the smallest labels is. Without any, nothing is learned and all
    probabilities are next to zero.
    """
    names = list(categories)
    ys = [f"y{i}" for i in range(len(names))]
    flags = labels.select(F.col(f"`{id_col}`").alias("id"), *(F.expr(c).cast("int").alias(y) for y, c in zip(ys, categories.values()))).dropna()
    cells = {tuple(r[y] for y in ys): r["n"] for r in flags.groupBy(*ys).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for cell, n in cells.items():
        share = F.when(F.concat_ws(",", *ys) == ",".join(map(str, cell)), F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = flags.withColumn("share", share).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    drawn = drawn.groupBy("id").agg(F.min(F.struct(*ys, "share")).alias("row"))  # a row for each id, so bounded
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text")).where(F.octet_length(text) <= SAMPLE_TEXT_BYTES)
    found = texts.join(F.broadcast(drawn), F.col("doc") == F.col("id")).groupBy("id").agg(F.min(F.struct("row", "text")).alias("one"))
    rows = found.select("id", "one.row.*", "one.text").collect()  # bounded by the sample
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r["text"], *(r[y] for y in ys), r["id"])):
        first.setdefault(r["text"], r)  # copies count once
    rows = sorted(first.values(), key=lambda r: (r["id"], r["text"]))
    if not rows:
        return Chain(names, [Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(i), -30.0) for i in range(len(names))])
    y = np.array([[r[c] for c in ys] for r in rows])
    return fit_chain([r["text"] for r in rows], y, np.array([1 / r["share"] for r in rows]), names)


def score(docs: DataFrame, chain: Chain, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, and p_<category> for each category; null and empty texts are scored by the bias alone."""
    names = [f"p_{c}" for c in chain.categories]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in names)])
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # MOST_WORDS weights a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            p = shared.value.probabilities(as_column(batch, "__text"))
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in keep), *(pa.array(x) for x in p.T)], schema.fieldNames())

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")), run, schema)


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more in the category; all columns, no shuffle.

    Null and empty texts are scored by the bias alone; repeated rows stay or go together; an empty table gives no
    rows; other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    k = chain.categories.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(shared.value.probabilities(as_column(batch, text_col))[:, k] < threshold))

    return map_arrow(docs, run, docs.schema)


#: The chain of the queries: the two judgements that the labels table holds.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), CATEGORIES), ["doc_id"])
    return scored.select("*", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
