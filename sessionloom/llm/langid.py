"""Language identification: the family first, then the language within it, by one-versus-one linear support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, is_held_out, materialize, table, texts_of
from .ngrams import labelled_sample, ngram_features, sigmoid

#: Languages by family; one that isn't named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "pl", "cs", "sk"),
    "baltic": ("lt", "lv"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
}
#: At most this many documents of each language are learned from.
SAMPLE, BITS, UNKNOWN = 1200, 12, "und"
#: And at most this many in all, should there be very many languages.
MOST_ROWS = 100_000


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, passes: int = 12, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """Weights (the last is the bias) of a linear support vector machine for y of -1 and 1, by dual coordinate descent; scale and shift
    that turn its margins into probabilities, by logistic regression."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.maximum((x * x).sum(1), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0, c)
            if step != alpha[i]:
                w += np.float32((step - alpha[i]) * y[i]) * x[i]
                alpha[i] = step
    m, a, b = x @ w, 2.0, 0.0
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(30):
        p = sigmoid(a * m + b)
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        a, b = np.clip(np.array([a, b]) - np.linalg.solve(h, g), -50, 50)
    return w, float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The machines, one for each two families and each two languages of a family, each fitted in a task of its own on a bounded sample of
    documents that aren't held out. What comes to the driver is the weights."""
    spark = docs.sparkSession
    own = labelled_sample(docs.where(~is_held_out() & F.col("doc_id").isNotNull()).select("doc_id", "lang"), "lang", sample, "langid")
    # a bounded number of rows, so that texts stay where they are
    some = F.broadcast(own.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(MOST_ROWS))
    own = materialize(docs.select("doc_id", "lang", "text").join(some, ["doc_id", "lang"]).where(F.col("text").rlike(r"\p{L}")).select("text", "lang"), "langid-sample")
    langs = sorted(r["lang"] for r in own.select("lang").distinct().collect())
    families = sorted({family(x) for x in langs})
    pairs = [("family", a, b) for a, b in combinations(families, 2)]
    pairs += [("language", a, b) for f in families for a, b in combinations([x for x in langs if family(x) == f], 2)]
    model = {"langs": langs, "families": families, "pairs": []}
    if not pairs:
        return model
    sides = [(level, a, b, x, 1 if (family(x) if level == "family" else x) == a else -1) for level, a, b in pairs for x in langs if (family(x) if level == "family" else x) in (a, b)]
    of = spark.createDataFrame(sides, "level string, a string, b string, side string, y int")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "text"], kind="stable")
        w, a, b = fit_svm(ngram_features(texts_of(rows["text"]), BITS, fold_case=True), rows["y"].to_numpy())
        return pd.DataFrame({"level": [key[0]], "a": [key[1]], "b": [key[2]], "w": [w.tolist()], "scale": [a], "shift": [b]})

    got = own.join(of, F.col("lang") == F.col("side")).groupBy("level", "a", "b").applyInPandas(fit, "level string, a string, b string, w array<float>, scale double, shift double")
    model["pairs"] = [(r["level"], r["a"], r["b"], np.array(r["w"], np.float32), r["scale"], r["shift"]) for r in got.collect()]
    return model


def _vote(names: list[str], level: str, model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the name that wins most duels (then: with the larger probabilities), and the least probability with which it won."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    won, least = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
    for lev, a, b, w, scale, shift in model["pairs"]:
        if lev == level and a in names:
            i, j = names.index(a), names.index(b)
            p = sigmoid(scale * (x @ w[:-1] + w[-1]) + shift)
            won[:, i] += (p >= 0.5) + 1e-3 * p
            won[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
    best = won.argmax(1)
    return best, least[np.arange(len(x)), best]


def predict(docs: DataFrame, model: dict, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, of which only the text goes to Python. A null text, or one without a letter, is `und` with score 0; so is
    all where nothing was learned."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights for each pair of languages
    found = fresh(docs, "language")[0]

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        by_family = [[x for x in m["langs"] if family(x) == f] for f in m["families"]]
        for batch in batches:
            out = []
            for part in chunks([batch.to_frame("text")], most_rows=256):
                texts = texts_of(part["text"])
                lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                if m["langs"] and known.any():
                    at = np.flatnonzero(known)
                    x = ngram_features([texts[i] for i in at], BITS, fold_case=True)
                    f, p = _vote(m["families"], "family", m, x)
                    for k, names in enumerate(by_family):
                        own = np.flatnonzero(f == k)
                        if len(own):
                            best, q = _vote(names, "language", m, x[own])
                            lang[at[own]] = np.array(names, object)[best]
                            score[at[own]] = p[own] * q
                out.append(pd.DataFrame({"lang": lang, "score": score}))
            yield pd.concat(out) if out else pd.DataFrame({"lang": [], "score": []})

    # not to be run again for a filter on its result
    scored = docs.withColumn(found, run.asNondeterministic()("text"))
    return scored.select(*docs.columns, F.col(f"{found}.lang").alias(lang_pred), F.col(f"{found}.score").alias(score))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows are judged alike; documents with a null doc_id aren't learned from; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", is_held_out().alias("held_out"), "text"), model).drop("text")


def confident(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents in which a language is found with at least that score; columns as in docs."""
    lang_pred, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, train(docs), lang_pred, score)
    return found.where((F.col(lang_pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
