"""Toxicity by weak supervision: many voters, a generative label model of them, a linear classifier of its posterior labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, is_held_out, materialize, table, texts_of
from .ngrams import labelled_sample, sigmoid
from .words import Words, joined, mix, powers

#: Labelled documents of each label that lexicons are learned from, and rows that the classifier is fitted to, of either side.
SAMPLE, FIT_ROWS = 8000, 8000
#: Terms are words (kind 0) and beginnings of words (kinds 1 to 3), hashed to this many bits with the kind in the last two; so many terms
#: are kept for and against.
BITS, PREFIXES, FOR, AGAINST = 20, (4, 5, 6), 4000, 1000
#: Voters: lexicons for, of bands of the strength of their terms, from slurs to words that only lean; a lexicon against of each kind; and
#: patterns (shouting, marks, repeated marks). 2 ** VOTERS bounds the patterns of votes.
KINDS = 1 + len(PREFIXES)
LEXICONS_FOR, LEXICONS_AGAINST, PATTERNS = 8, KINDS, 3
VOTERS = LEXICONS_FOR + LEXICONS_AGAINST + PATTERNS
_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(c).isalpha() for c in range(128)]
_CAPITAL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK[list(b"#*$%&")] = True


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Term and text of every word and of every word's beginnings."""
    words = Words([t.lower() for t in texts], _GAPS)
    shift, two = np.uint64(66 - BITS), np.uint64(2)
    terms, docs = [words.hash >> shift << two], [words.doc]
    power = powers(max(PREFIXES) + 1)
    part = np.zeros(len(words.hash), np.uint64)
    for k in range(max(PREFIXES)):
        at = np.minimum(words.begin + k, len(words.data) - 1)
        part = part + (words.data[at].astype(np.uint64) + np.uint64(1)) * power[k]
        if k + 1 in PREFIXES:
            long = words.length > k + 1
            terms.append((mix(part[long] + np.uint64(k + 1)) >> shift << two) + np.uint64(1 + PREFIXES.index(k + 1)))
            docs.append(words.doc[long])
    return np.concatenate(terms).astype(np.int64), np.concatenate(docs)


def learn_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers that speak for toxicity and against it, in (text, toxic), the strongest first; FOR + AGAINST at most."""

    def count(batches):
        n = np.zeros((2, 1 << BITS), np.int64)
        for part in chunks(batches):
            term, doc = _terms(texts_of(part["text"]))
            once = np.unique(doc << BITS | term)
            toxic = part["toxic"].to_numpy()[once >> BITS]
            for y in (0, 1):
                n[y] += np.bincount(once[toxic == y] & ((1 << BITS) - 1), minlength=1 << BITS)
        used = np.flatnonzero(n.sum(0))
        yield pd.DataFrame({"term": used, "n0": n[0, used], "n1": n[1, used]})

    of = sample.agg(F.sum(1 - F.col("toxic")).alias("of0"), F.sum("toxic").alias("of1")).first()
    of0, of1 = of["of0"] or 0, of["of1"] or 0
    counts = sample.select("text", "toxic").mapInPandas(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (of1 + 1.0)) - F.log((F.col("n0") + 0.5) / (of0 + 1.0))
    rated = materialize(counts.withColumn("odds", odds).where("(n1 >= 5 and odds >= 2) or (n0 >= 20 and odds <= -1.5)"), "toxic-terms")
    up = rated.where("odds > 0").orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "term").limit(FOR).toPandas()["term"]
    down = rated.where("odds < 0").orderBy(F.asc(F.col("odds") * F.sqrt("n0")), "term").limit(AGAINST).toPandas()["term"]
    return up.to_numpy(np.int64), down.to_numpy(np.int64)


def _shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the shares of capitals, of marks, and of double exclamation marks among its bytes."""
    data, ends = joined([t.encode("utf-8", "surrogatepass") for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    size = np.maximum(ends - starts - 1, 1)
    of = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64) / size
    bang = data == 33
    bang[1:] &= bang[:-1]
    bang[0] = False
    return of(_CAPITAL[data]), of(_MARK[data]), of(bang)


def votes(docs: DataFrame, up: np.ndarray, down: np.ndarray) -> DataFrame:
    """docs (doc_id, held_out, text) with, in place of the text, hits (places in the terms that it holds) and vote (a bit for each voter)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((up, down))  # FOR + AGAINST numbers

    def run(batches):
        up, down = held.value
        every = np.concatenate((up, down))
        order = np.argsort(every, kind="stable")
        places = every[order]
        voter = np.concatenate((np.arange(len(up)) * LEXICONS_FOR // max(len(up), 1), LEXICONS_FOR + (down & 3))).astype(np.int64)
        for part in chunks(batches):
            texts = texts_of(part["text"])
            term, doc = _terms(texts)
            hits, vote = [np.zeros(0, np.int32)] * len(texts), np.zeros(len(texts), np.int64)
            if len(places) and len(term):
                at = np.minimum(np.searchsorted(places, term), len(places) - 1)
                found = places[at] == term
                once = np.unique(doc[found] << 32 | order[at[found]])
                own, what = once >> 32, (once & 0xFFFFFFFF).astype(np.int32)
                np.bitwise_or.at(vote, own, 1 << voter[what])
                for k, got in zip(np.unique(own), np.split(what, np.flatnonzero(np.diff(own)) + 1), strict=True):
                    hits[k] = got
            for i, (share, most) in enumerate(zip(_shares(texts), (0.3, 0.05, 0.01), strict=True)):
                vote |= (share > most).astype(np.int64) << (LEXICONS_FOR + LEXICONS_AGAINST + i)
            yield part.drop(columns="text").assign(hits=hits, vote=vote)

    return docs.mapInPandas(run, "doc_id long, held_out boolean, hits array<int>, vote long")


class _Tree:
    """P(votes) of one label: the tree of voters that tells most of how they depend on each other, each voter given the one above it."""

    def __init__(self, fires: np.ndarray, weight: np.ndarray):
        """fires: patterns by voters, 0 or 1; weight: documents with each pattern."""
        n, one = weight.sum(), weight @ fires
        both = (fires * weight[:, None]).T @ fires
        cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None] - both, (0, 0): n - one[:, None] - one[None] + both}
        told = np.zeros_like(both)  # mutual information of each two voters
        total = n + 4
        for (a, b), k in cells.items():
            p = (k + 1) / total
            edge = lambda x, v: ((one if v else n - one) + 2) / total
            told += p * np.log(p / (edge(0, a)[:, None] * edge(1, b)[None]))
        v = fires.shape[1]
        self.above, inside = np.full(v, -1), [0]
        while len(inside) < v:  # the next voter is the one that is tied most to one inside
            rest = [i for i in range(v) if i not in inside]
            i, j = divmod(int(told[np.ix_(rest, inside)].argmax()), len(inside))
            self.above[rest[i]] = inside[j]
            inside.append(rest[i])
        self.rate = (one + 1) / (n + 2)
        self.given = np.array([[self.rate[i]] * 2 if j < 0 else [(cells[1, a][i, j] + 1) / (cells[1, a][i, j] + cells[0, a][i, j] + 2) for a in (0, 1)] for i, j in enumerate(self.above)])

    def log_p(self, fires: np.ndarray) -> np.ndarray:
        state = np.where(self.above >= 0, fires[:, np.maximum(self.above, 0)], 0)
        p = self.given[np.arange(fires.shape[1]), state]
        return np.log(np.where(fires == 1, p, 1 - p)).sum(1)


class LabelModel:
    """P(toxic | votes): a generative model of the votes given the label, fitted by expectation maximisation. Given a label voters depend on
    each other along a tree (the one with the most mutual information), so that voters that repeat each other aren't counted twice."""

    def __init__(self, patterns: np.ndarray, n: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 25, voters: int = VOTERS):
        """patterns: vote numbers; n: documents with them; toxic, clean: learnable labelled ones among these, which anchor the labels."""
        self.fires = (patterns[:, None] >> np.arange(voters)) & 1
        self._fit(toxic, clean)
        for _ in range(rounds):
            p = self.posterior()
            self._fit(n * p + toxic, n * (1 - p) + clean)

    def _fit(self, toxic: np.ndarray, clean: np.ndarray) -> None:
        self.yes, self.no = _Tree(self.fires, toxic), _Tree(self.fires, clean)
        self.share = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)

    def posterior(self) -> np.ndarray:
        share = min(max(self.share, 1e-4), 1 - 1e-4)
        return sigmoid(np.log(share / (1 - share)) + self.yes.log_p(self.fires) - self.no.log_p(self.fires))


def fit_linear(hits: list[np.ndarray], vote: np.ndarray, target: np.ndarray, weight: np.ndarray, n_terms: int, steps: int = 300, rate: float = 0.05, penalty: float = 1e-5) -> np.ndarray:
    """Logistic regression of soft targets on terms, voters and a constant, by Adam."""
    cols = [np.concatenate((h, n_terms + np.flatnonzero((v >> np.arange(VOTERS)) & 1), [n_terms + VOTERS])).astype(np.int64) for h, v in zip(hits, vote, strict=True)]
    row, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)
    w = np.zeros(n_terms + VOTERS + 1)
    m, s, weight = np.zeros_like(w), np.zeros_like(w), weight / weight.sum()
    for k in range(1, steps + 1):
        p = sigmoid(np.bincount(row, w[col], minlength=len(cols)))
        g = np.bincount(col, (weight * (p - target))[row], minlength=len(w)) + penalty * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
    return w


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (doc_id, text; labels: doc_id, toxic).

    Lexicons come from a bounded sample of labelled documents that aren't held out. All documents then vote; the counts of vote patterns
    (2 ** VOTERS at most) go to the label model, whose posterior labels a bounded sample of learnable documents carries into the linear
    classifier. Null texts count as empty; null labels and ones but 0 and 1 as none; of several labels for a document the highest holds. Repeated rows are scored
    alike. Without learnable labels the score is that of no evidence. An empty table gives no rows.
    """
    spark = docs.sparkSession
    given = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    open_ = given.where(~is_held_out())
    some = labelled_sample(open_, "toxic", SAMPLE, "toxicity").select("doc_id", "toxic")
    # the sample has at most 2 * SAMPLE rows, so that texts stay where they are
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic"), "toxic-sample")
    up, down = learn_terms(sample.dropDuplicates(["text", "toxic"]))  # else copies would make their own words telling
    n_terms = len(up) + len(down)
    voted = materialize(votes(docs.select("doc_id", is_held_out().alias("held_out"), "text"), up, down), "toxic-votes")
    seen = voted.select("doc_id", "vote").join(open_, "doc_id", "left").groupBy("vote").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).toPandas().fillna(0)
    if not len(seen):
        return voted.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    seen = seen.sort_values("vote")
    model = LabelModel(seen["vote"].to_numpy(np.int64), seen["n"].to_numpy(float), seen["t"].to_numpy(float), seen["c"].to_numpy(float))
    posterior = spark.createDataFrame(pd.DataFrame({"vote": seen["vote"].to_numpy(np.int64), "posterior": model.posterior()}), "vote long, posterior double")
    target = voted.where(~F.col("held_out")).join(F.broadcast(posterior), "vote")  # 2 ** VOTERS rows
    target = target.withColumn("side", (F.col("posterior") >= 0.5).cast("int"))
    fitted = labelled_sample(target.select("doc_id", "hits", "vote", "posterior", "side"), "side", FIT_ROWS, "toxic-fit")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["side", "doc_id"], kind="stable")
        weight = (own["sampled_of"] / own.groupby("side")["side"].transform("size")).to_numpy(float)
        w = fit_linear(list(own["hits"]), own["vote"].to_numpy(), own["posterior"].to_numpy(), np.sqrt(weight), n_terms)
        return pd.DataFrame({"w": [w.tolist()]})

    got = materialize(fitted, "toxic-fit").groupBy().applyInPandas(fit, "w array<double>").collect()
    held = spark.sparkContext.broadcast(np.array(got[0]["w"]) if got else np.zeros(n_terms + VOTERS + 1))

    def score(batches):
        w = held.value
        for part in batches:
            bits = (part["vote"].to_numpy()[:, None] >> np.arange(VOTERS)) & 1
            terms = np.array([w[h].sum() if len(h) else 0.0 for h in part["hits"]], float)
            p = sigmoid(terms + bits @ w[n_terms:-1] + w[-1])
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": p, "predicted": (p >= 0.5).astype(int)})

    return voted.select("doc_id", "held_out", "hits", "vote").mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity of all documents: null and empty texts have the score of no evidence, repeated rows and ties are scored alike, null doc_ids aren't
    learned from, an empty table gives no rows, other columns aren't read."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
