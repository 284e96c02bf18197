"""Hashed byte n-gram features, and bounded samples of labelled rows to fit models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def ngram_features(texts: list[str], bits: int, size: int = 3, fold_case: bool = False) -> np.ndarray:
    """A row a text: square roots of the shares of hashed byte runs, so that each row has length 1 (0 for empty texts)."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for k, text in enumerate(texts):
        data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
        if fold_case:
            data = _FOLD[data]
        n = len(data) - size + 1
        if n <= 0 or not text:
            continue
        code = data[:n].astype(np.uint32)
        for i in range(1, size):
            code = (code << np.uint32(8)) | data[i : n + i]
        got = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
        out[k] = np.sqrt(got / n)
    return out


def labelled_sample(docs: DataFrame, label: str, most: int, seed: str) -> DataFrame:
    """At most `most` rows of each value of `label`, taken by a hash of doc_id; adds sampled_of, the number of rows with that label.

    The label sizes, a row a label, are broadcast. A first cut by the hash leaves little more than `most` rows a label, whatever their number, and only these are ranked.
    """
    own = docs.where(F.col(label).isNotNull())
    size = own.groupBy(F.col(label).alias("label_")).agg(F.count(F.lit(1)).alias("sampled_of"))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    cut = own.join(F.broadcast(size), F.col(label) == F.col("label_")).withColumn("place_", place).where(F.col("place_") * F.col("sampled_of") < 1.2 * most + 20)
    order = Window.partitionBy(label).orderBy("place_", "doc_id")
    return cut.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= most).drop("rank_", "place_", "label_")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
