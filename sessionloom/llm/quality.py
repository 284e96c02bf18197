"""Quality grades by ordinal regression: one set of hashed-text weights, ordered thresholds between the grades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, is_held_out, materialize, table, texts_of
from .ngrams import labelled_sample, ngram_features, sigmoid
from .perplexity import base_rules

#: At most this many rated documents of each grade are learned from.
SAMPLE, BITS = 2500, 12
#: And at most this many in all, should there be very many grades.
MOST_ROWS = 25_000
#: A document is selected if its grade is above the lowest with at least this probability.
LEAST_TAIL = 0.4


def features(texts: list[str]) -> np.ndarray:
    """Hashed byte runs of the text, and how long, repetitive and full of marks it is."""
    b = base_rules(texts)
    n = np.maximum(b["n_words"], 1)
    extra = np.column_stack([np.log1p(b["n_words"]) / 8, b["n_words"] < 50, b["word_chars"] / n / 16, np.minimum(b["n_symbols"] / n, 2), np.minimum(b["n_dup_lines"] / 8, 1), b["n_repeat_words"] / n])
    return np.hstack([ngram_features(texts, BITS), extra.astype(np.float32)])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = 250, rate: float = 0.1, penalty: float = 1e-5) -> dict:
    """P(grade > k) = sigmoid(w.x - t_k) with t_1 < t_2 < ...: the first threshold is free, the others add an exponential. Adam on the log
    likelihood of the grades; weight: rows a sampled row stands for."""
    levels = np.unique(grade)
    y, cuts = np.searchsorted(levels, grade), len(levels) - 1
    if cuts < 1:
        return {"levels": levels, "w": np.zeros(x.shape[1], np.float32), "t": np.zeros(0)}
    weight = weight / weight.sum()
    p = np.zeros(x.shape[1] + cuts)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[-cuts + 1 :]) if cuts > 1 else np.zeros(0)
        t = p[x.shape[1]] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = x @ p[: x.shape[1]].astype(np.float32)
        over = sigmoid(z[:, None] - t)  # P(grade > k)
        both = np.hstack([np.ones((len(x), 1)), over, np.zeros((len(x), 1))])
        rows = np.arange(len(x))
        own = np.maximum(both[rows, y] - both[rows, y + 1], 1e-9)
        slope = both * (1 - both)
        g_up, g_down = slope[rows, y] / own, slope[rows, y + 1] / own
        g_z = -weight * (g_up - g_down)
        g_t = np.zeros(cuts)
        np.add.at(g_t, y[y > 0] - 1, (weight * g_up)[y > 0])
        np.add.at(g_t, y[y < cuts], -(weight * g_down)[y < cuts])
        tail = g_t[::-1].cumsum()[::-1]
        g = np.concatenate((x.T @ g_z.astype(np.float32), [tail[0]], tail[1:] * gaps)) + penalty * np.concatenate((p[: x.shape[1]], np.zeros(cuts)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    gaps = np.exp(p[-cuts + 1 :]) if cuts > 1 else np.zeros(0)
    return {"levels": levels, "w": p[: x.shape[1]].astype(np.float32), "t": p[x.shape[1]] + np.concatenate(([0.0], np.cumsum(gaps)))}


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> dict:
    """ratings: doc_id, quality. Fits on a bounded sample of rated documents that aren't held out, in one task of that bound."""
    rated = ratings.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("grade"))
    some = labelled_sample(rated.where(~is_held_out()), "grade", sample, "quality")
    # a bounded number of rows, so that texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)), "doc_id").select("text", "grade", "sampled_of")
    rows = materialize(rows, "quality-sample")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["grade", "text"], kind="stable")
        grade = own["grade"].to_numpy()
        of = own.groupby("grade")["sampled_of"].transform("max").to_numpy() / own.groupby("grade")["grade"].transform("size").to_numpy()
        m = fit_ordinal(features(texts_of(own["text"])), grade, of)
        return pd.DataFrame({"levels": [m["levels"].tolist()], "w": [m["w"].tolist()], "t": [m["t"].tolist()]})

    got = rows.groupBy().applyInPandas(fit, "levels array<double>, w array<float>, t array<double>").collect()
    return {k: np.array(got[0][k]) for k in ("levels", "w", "t")} if got else {"levels": np.zeros(1), "w": np.zeros(0), "t": np.zeros(0)}


def grade(docs: DataFrame, model: dict, least_tail: float = LEAST_TAIL) -> DataFrame:
    """docs with expected_grade, tail_probability (of a grade above the lowest) and selected (with "_" behind a name that docs has already). Null
    texts count as empty. Where no grades or only one was learned, the grade is that one (or 0), the probability 1."""
    names = fresh(docs, "expected_grade", "tail_probability", "selected")
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches):
        m = held.value
        levels, w, t = m["levels"], m["w"].astype(np.float32), m["t"]
        for part in chunks(batches, most_rows=256):
            if len(t):
                over = sigmoid((features(texts_of(part["text"])) @ w)[:, None] - t)
                yield part.assign(**dict(zip(names, (levels[0] + over @ np.diff(levels), over[:, 0], over[:, 0] >= least_tail), strict=True)))
            else:
                yield part.assign(**dict(zip(names, (float(levels[0]), 1.0, True), strict=True)))

    kinds = zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)
    return docs.mapInPandas(run, T.StructType([*docs.schema.fields, *(T.StructField(*k) for k in kinds)]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows are judged alike; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade(docs.select("doc_id", is_held_out().alias("held_out"), "text"), model).drop("text")
