"""Quality rules: word counts, repetition, and the perplexity of a modified Kneser-Ney model of the document's language."""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, remove, shared_dir, table, texts_of
from .words import SPACE, Words, mix

#: The alphabet, the length of the model's runs (a code must fit 63 bits: 11 at most), and that of the first model's, which only chooses what
#: the model is trained on.
SYMBOLS, ORDER, FIRST_ORDER = 47, 6, 4
#: Texts are kept in blocks of one language of about so many symbols, as a run is looked up once a block; a task holds HELD at most.
BLOCK, HELD = 8_000_000, 32_000_000
#: Languages whose first models are broadcast, by number of documents; the others' are sent to parts of about PART_ROWS of their documents.
MOST_SHARED, PART_ROWS = 16, 2000
#: A document is out if it is further than this many interquartile ranges from the quartiles of its language.
FENCE = 3.0
LEAST_WORDS, MOST_REPEATED = 50, 50
_COUNTS = "group string, code long, n long"
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True


def _alphabet() -> np.ndarray:
    """One or two symbols of every byte (-1: none). White space 0, letters 1-26, a mark before capitals 27 and digits 28, sentence marks 29, other marks 30, and half bytes 31-46: a digit has its mark and one of these, a byte outside ASCII has two, so case, digits and other scripts stay."""
    out = np.full((256, 2), -1, np.int32)
    out[:128, 0] = 30
    out[SPACE, 0] = 0
    out[list(b".,;:?'\"-()"), 0] = 29
    out[97:123, 0] = out[65:91, 1] = np.arange(1, 27)
    out[65:91, 0] = 27
    out[48:58, 0], out[48:58, 1] = 28, 31 + np.arange(10)
    high = np.arange(128, 256)
    out[128:, 0], out[128:, 1] = 31 + (high >> 4), 31 + (high & 15)
    return out


#: Both symbols of a byte as one number of two bytes.
_SYMBOL = _alphabet().astype(np.int8).view(np.int16)[:, 0].copy()


def _symbols(text: str) -> np.ndarray:
    """The symbols of a text, with a line feed before and after it."""
    s = _SYMBOL[np.frombuffer(b"\n" + text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)].view(np.int8)
    return s[s >= 0]


def _codes(symbols: np.ndarray, order: int) -> np.ndarray:
    """The code of each run of so many symbols."""
    n = max(len(symbols) - order + 1, 0)
    code = symbols[:n].astype(np.int64)
    for k in range(1, order):
        code *= SYMBOLS
        code += symbols[k : n + k]
    return code


def _runs(text: str) -> np.ndarray:
    """The codes of a text's runs of ORDER symbols."""
    return _codes(_symbols(text), ORDER)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _pack(value) -> bytes:
    raw = pickle.dumps(value)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def _unpack(raw: bytes):
    return pickle.loads(pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True))


class Runs:
    """The runs of a block of texts, given as symbols and the number of symbols a text: each different run's code, each run's place among
    these, text by text, and the number of runs a text. None goes from one text to another."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, order: int):
        ends = np.cumsum(sizes)
        inside = np.ones(len(symbols), bool)
        for k in range(order - 1):
            inside[np.maximum(ends - 1 - k, ends - sizes)] = False
        codes = _codes(symbols, order)
        self.at, self.codes = pd.factorize(codes[inside[: len(codes)]])
        self.counts = np.maximum(sizes - order + 1, 0)

    def only(self, texts: np.ndarray) -> np.ndarray:
        """How often each different run is in the texts that are true."""
        return np.bincount(self.at[np.repeat(texts, self.counts)], minlength=len(self.codes))

    def texts_with(self, texts: np.ndarray) -> np.ndarray:
        """In how many of the texts that are true each different run is."""
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        pairs = (text * max(len(self.codes), 1) + self.at)[np.repeat(texts, self.counts)]
        return np.bincount(_distinct(pairs) % max(len(self.codes), 1), minlength=len(self.codes))

    def means(self, values: np.ndarray) -> np.ndarray:
        """Each text's mean of the values of its runs; nan without runs."""
        out = np.full(len(self.counts), np.nan)
        some = np.flatnonzero(self.counts)
        if len(some):
            starts = (np.cumsum(self.counts) - self.counts)[some]
            out[some] = np.add.reduceat(values[self.at], starts, dtype=np.float64) / self.counts[some]
        return out


def _blocks(batches, most: int = BLOCK):
    """Rows as blocks of one group: block (a name), group, docs (packed: doc_id, lang, base rules, a digest of the text as its key), symbols
    (packed, with their number a text)."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def block(group):
        docs, symbols = zip(*held.pop(group), strict=True)
        del sizes[group]
        symbols = [s for own in symbols for s in own]
        packed_symbols = _pack((np.concatenate(symbols), np.array([len(x) for x in symbols])))
        return pd.DataFrame({"block": [uuid.uuid4().hex], "group": [group], "docs": [_pack(pd.concat(docs, ignore_index=True))], "symbols": [packed_symbols]})

    for part in chunks(batches):
        texts = texts_of(part["text"])
        docs = base_rules(texts)
        docs["base_failed"] = _failed(docs)
        docs["key"] = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        docs["doc_id"], docs["lang"] = part["doc_id"].astype("Int64").array, part["lang"].array
        symbols = [_symbols(t) for t in texts]
        for group, at in part.reset_index(drop=True).groupby("group").indices.items():
            held.setdefault(group, []).append((docs.iloc[at], [symbols[i] for i in at]))
            sizes[group] = sizes.get(group, 0) + sum(len(symbols[i]) for i in at)
            if sizes[group] > most:
                yield block(group)
        while sum(sizes.values()) > HELD:
            yield block(max(sizes, key=sizes.get))
    for group in list(held):
        yield block(group)


_BLOCKS = "block string, group string, docs binary, symbols binary"


def _kept_blocks(blocks: DataFrame) -> tuple[DataFrame, str]:
    """The blocks as a table in the shared folder that is dealt out by block, so that joins on block don't shuffle texts, and its name."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name), name


def _rows(batches):
    for batch in batches:
        yield from batch.itertuples(index=False)


def _runs_in(blocks):
    """group, code, n of all runs of ORDER symbols."""
    for row in _rows(blocks):
        symbols, sizes = _unpack(row.symbols)
        runs = Runs(symbols, sizes, ORDER)
        yield pd.DataFrame({"group": row.group, "code": runs.codes, "n": runs.only(np.ones(len(sizes), bool))})


def _texts_with(blocks):
    """group, code, n: in how many of the texts that pass the base rules a run of FIRST_ORDER symbols is."""
    for row in _rows(blocks):
        runs = Runs(*_unpack(row.symbols), FIRST_ORDER)
        n = runs.texts_with(~_unpack(row.docs)["base_failed"].to_numpy(bool))
        yield pd.DataFrame({"group": row.group, "code": runs.codes[n > 0], "n": n[n > 0]})


def count_runs(docs: DataFrame) -> DataFrame:
    """group, code, n: how often each run of ORDER symbols occurs in the texts of a language, over all documents (group, text)."""
    named = docs.select("group", "text", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"))
    return named.mapInPandas(lambda batches: _runs_in(_blocks(batches)), _COUNTS).groupBy("group", "code").agg(F.sum("n").alias("n"))


def counts_by_order(runs: DataFrame, order: int = ORDER) -> DataFrame:
    """group, size, code, n: counts for the longest runs, and for shorter ones the number of different symbols seen before them."""
    levels = [runs.select("group", F.lit(order).alias("size"), "code", "n")]
    for size in range(order - 1, 0, -1):
        longer = levels[-1]
        levels.append(longer.groupBy("group", (F.col("code") % F.lit(SYMBOLS**size)).alias("code")).agg(F.count(F.lit(1)).alias("n")).select("group", F.lit(size).alias("size"), "code", "n"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _discounts(c: list) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more, by how many runs have the counts 1, 2, 3 and 4."""
    if not c[0] or not c[1]:
        return np.array([0, 0.5, 0.75, 0.9])
    y = c[0] / (c[0] + 2 * c[1])
    d = [0.0] + [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.clip(d, 0, [0, 0.999, 1.999, 2.999])


def _rare(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _hash(code: np.ndarray) -> np.ndarray:
    return mix(np.asarray(code).astype(np.uint64) + np.uint64(1))


def fit(counts: pd.DataFrame, rare: dict[int, list[int]] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One language's model, or a slice of it that has all runs of its contexts, with `rare` of the whole language: for each size of runs the sorted hashes of those that were seen and their discounted probabilities, the sorted
    hashes of their contexts and the shares that these leave to the shorter size. The hash is one to one."""
    model = {}
    for size, own in counts.groupby("size"):
        code, n = own["code"].to_numpy(), own["n"].to_numpy().astype(float)
        d = _discounts(rare[size] if rare else _rare(n))
        kind = np.minimum(n, 3).astype(int)
        context, at = np.unique(code // SYMBOLS, return_inverse=True)
        total = np.bincount(at, n)
        runs, contexts = _hash(code), _hash(context)
        by_run, by_context = np.argsort(runs), np.argsort(contexts)
        left = np.bincount(at, d[kind]) / total
        model[int(size)] = (runs[by_run], ((n - d[kind]) / total[at])[by_run], contexts[by_context], left[by_context])
    return model


def packed(model) -> bytes:
    """A model with shorter numbers."""
    return pickle.dumps({size: (runs, p.astype(np.float32), contexts, left.astype(np.float32)) for size, (runs, p, contexts, left) in model.items()})


def _found(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray, none: float) -> np.ndarray:
    """The values of the wanted hashes, by binary search."""
    if not len(hashes):
        return np.full(len(wanted), none)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, values[at], none)


class Lookup:
    """Log probability of the last symbol of runs, by their codes."""

    def __init__(self, model: bytes | None):
        self.model = pickle.loads(model) if model else {}

    def _p(self, code: np.ndarray, size: int) -> np.ndarray:
        if not size:
            return np.full(len(code), 1 / SYMBOLS)
        below = self._p(code % SYMBOLS ** (size - 1), size - 1)
        if size not in self.model:
            return below
        runs, p, contexts, left = self.model[size]
        return _found(runs, p, _hash(code), 0.0) + _found(contexts, left, _hash(code // SYMBOLS), 1.0) * below

    def __call__(self, code: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self._p(code, max(self.model, default=0)), 1e-12)).astype(np.float32)


def base_rules(texts: list[str]) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = Words(texts)
    of = lambda flags: np.add.reduceat(flags, words.text_starts, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    chars = ~SPACE[words.data] & ((words.data & 0xC0) != 0x80)
    repeated = np.zeros(len(words.hash) + 3, np.int64)
    value, at = words.windows(3)
    if len(at):
        own = mix(value + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal in one text only
        again = np.sort(own)
        again = _distinct(again[1:][again[1:] == again[:-1]])
        twice = again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own if len(again) else np.zeros(len(at), bool)
        for k in range(3):
            repeated[at[twice] + k] = 1
    inside = np.bincount(words.doc, repeated[: len(words.hash)], minlength=len(texts)).astype(np.int64)
    again = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        again.append(len(lines) - len(set(lines)))
    return pd.DataFrame({"n_words": words.count, "word_chars": of(chars), "n_symbols": of(_MARKS[words.data]), "n_dup_lines": again, "n_repeat_words": inside})


def _failed(base: pd.DataFrame) -> pd.Series:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def _surprise(look_up: Lookup, row) -> np.ndarray:
    """Each text's mean of the squares of log p: a few symbols that are hardly ever seen weigh more than many easy ones."""
    runs = Runs(*_unpack(row.symbols), FIRST_ORDER)
    return np.nan_to_num(runs.means(np.square(look_up(runs.codes))))


def _surprises(batches, table_of):
    """group, block, place in the block, key and surprise of the texts that pass the base rules."""
    for row in _rows(batches):
        docs = _unpack(row.docs).assign(group=row.group, block=row.block, surprise=_surprise(table_of(row.group), row))
        yield docs.assign(place=np.arange(len(docs))).loc[~docs["base_failed"].to_numpy(bool), _SURPRISE_NAMES]


_SURPRISE = "group string, block string, place int, key binary, surprise double"
_SURPRISE_NAMES = [c.split()[0] for c in _SURPRISE.split(", ")]


def _slice_of(code: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a language's runs, by the last two symbols before the last one, which a run and its ends of three symbols or more share."""
    return (_hash(code // SYMBOLS % SYMBOLS**2) % np.uint64(slices)).astype(np.int64)


def _wanted(key, blocks: pd.DataFrame, training: pd.DataFrame) -> pd.DataFrame:
    """A block's different runs of ORDER symbols by slice, and how often they are in the texts at the places to train on."""
    row = blocks.iloc[0]
    symbols, sizes = _unpack(row["symbols"])
    chosen = np.zeros(len(sizes), bool)
    for places in training["places"]:
        chosen[places] = True
    runs = Runs(symbols, sizes, ORDER)
    order = np.argsort(runs.codes)
    code, n = runs.codes[order], runs.only(chosen)[order]
    of = _slice_of(code, row["slices"])
    out = []
    for k in np.unique(of):
        own = np.flatnonzero(of == k)
        out.append((row["group"], k, row["block"], row["slices"], _pack((np.diff(code[own], prepend=0), n[own].astype(np.int32)))))
    return pd.DataFrame(out, columns=_WANTED_NAMES)


_WANTED = "group string, slice int, block string, slices int, runs binary"
_WANTED_NAMES = [c.split()[0] for c in _WANTED.split(", ")]


def _block_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = _unpack(raw)
    return np.cumsum(steps), n


def _added(blocks) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of many blocks in order, and their counts added up; a few million codes are held at once besides these."""
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add():
        all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(all_codes)
        all_codes, all_counts = all_codes[order], all_counts[order]
        first = np.flatnonzero(np.concatenate(([True], all_codes[1:] != all_codes[:-1]))) if len(all_codes) else np.zeros(0, np.int64)
        codes[:] = [all_codes[first]]
        counts[:] = [np.add.reduceat(all_counts, first) if len(first) else all_counts]

    for raw in blocks:
        code, n = _block_runs(raw)
        codes.append(code)
        counts.append(n)
        if sum(map(len, codes[1:])) > max(2_000_000, len(codes[0])):
            add()
    add()
    return codes[0], counts[0]


def _levels(code: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Runs and their counts by size, down to two symbols; for shorter ones than ORDER the number of different symbols before them."""
    out = {ORDER: (code[n > 0], n[n > 0])}
    for size in range(ORDER - 1, 1, -1):
        out[size] = np.unique(out[size + 1][0] % SYMBOLS**size, return_counts=True)
    return out


def _statistics(slice_: pd.DataFrame) -> pd.DataFrame:
    """group, size, code, n of a slice: for sizes of three or more how many runs have the counts 1 to 4 (code), for two the runs themselves."""
    out = []
    for size, (code, n) in _levels(*_added(slice_["runs"])).items():
        out.append(pd.DataFrame({"size": size, "code": code, "n": n} if size == 2 else {"size": size, "code": [1, 2, 3, 4], "n": _rare(n)}))
    return pd.concat(out).assign(group=slice_["group"].iloc[0])[["group", "size", "code", "n"]]


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """What all slices of a language need: its runs of one and two symbols, at most SYMBOLS ** 2 + SYMBOLS, and its rare counts by size."""
    pairs = rows.loc[(rows["size"] == 2) & (rows["n"] > 0), ["size", "code", "n"]].sort_values("code")
    code, n = np.unique(pairs["code"].to_numpy() % SYMBOLS, return_counts=True)
    short = pd.concat([pairs, pd.DataFrame({"size": 1, "code": code, "n": n})], ignore_index=True)
    rare = {size: [int(rows.loc[(rows["size"] == size) & (rows["code"] == k), "n"].sum()) for k in (1, 2, 3, 4)] for size in range(3, ORDER + 1)}
    rare |= {size: _rare(own["n"].to_numpy()) for size, own in short.groupby("size")}
    return pd.DataFrame({"group": [rows["group"].iloc[0]], "shared": [_pack((short, rare))]})


_ANSWERS = "block string, slice int, slices int, p binary"


def _answers(key, slice_: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """For each block the log probabilities of the runs that it wants from a slice, in order of their codes."""
    if not len(slice_):
        return pd.DataFrame({"block": [], "slice": [], "slices": [], "p": []})
    short, rare = _unpack(shared["shared"].iloc[0])
    code, n = _added(slice_["runs"])
    levels = [pd.DataFrame({"size": size, "code": c, "n": k}) for size, (c, k) in _levels(code, n).items() if size > 2]
    p = Lookup(pickle.dumps(fit(pd.concat([short, *levels]), rare)))(code)
    out = [_pack(p[np.searchsorted(code, _block_runs(raw)[0])]) for raw in slice_["runs"]]
    return pd.DataFrame({"block": slice_["block"], "slice": slice_["slice"], "slices": slice_["slices"], "p": out})


def _scores(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with the mean of -log p of their runs."""
    row = blocks.iloc[0]
    docs = _unpack(row["docs"])
    runs = Runs(*_unpack(row["symbols"]), ORDER)
    values = np.zeros(len(runs.codes), np.float32)
    if len(answers):
        order = np.argsort(runs.codes)
        of = _slice_of(runs.codes[order], int(answers["slices"].iloc[0]))
        for k, p in zip(answers["slice"], answers["p"], strict=True):
            values[order[of == k]] = _unpack(p)
    means = runs.means(-values)
    return docs.assign(group=row["group"], log_perplexity=np.where(np.isnan(means), None, means))[_NAMES]


_SCORES = "doc_id long, lang string, group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double"
_NAMES = [c.split()[0] for c in _SCORES.split(", ")]


class Models:
    """The first models of all languages (groups), made from counts of runs of FIRST_ORDER symbols, each in a task of its own.

    The `common` languages' models are broadcast. Every other language's model is one row that is sent to the parts of its documents,
    which are as many as `parts` says, so that the number of languages is not bounded and none shares a model with another.
    """

    def __init__(self, runs: DataFrame, common: list[str], parts: DataFrame | None):
        made = counts_by_order(materialize(runs, "runs"), FIRST_ORDER).groupBy("group").applyInPandas(lambda x: pd.DataFrame({"group": [x["group"].iloc[0]], "model": [packed(fit(x))]}), "group string, model binary")
        made = materialize(made, "models")
        self.common = common
        own = made.where(F.col("group").isin(common)).collect()  # MOST_SHARED rows; the alphabet bounds each
        self.shared = runs.sparkSession.sparkContext.broadcast({r["group"]: bytes(r["model"]) for r in own})
        self.rows = self.parts = None
        if parts is not None:
            self.parts = parts
            rest = made.where(~F.col("group").isin(common))
            self.rows = rest.join(F.broadcast(parts), "group").select("group", "model", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def apply(self, blocks: DataFrame, rows_of, kind: str) -> DataFrame:
        """rows_of(batches, table_of) over all blocks, each with its language's model."""
        shared = self.shared

        def common(batches):
            tables = {}

            def table_of(group):
                if group not in tables:
                    if len(tables) >= 4:
                        tables.pop(next(iter(tables)))
                    tables[group] = Lookup(shared.value.get(group))
                return tables[group]

            yield from rows_of(batches, table_of)

        out = blocks.where(F.col("group").isin(self.common)).mapInPandas(common, kind)
        if self.rows is None:
            return out
        names = [c.split()[0] for c in kind.split(", ")]

        def one(key, blocks, model):
            table = Lookup(model["model"].iloc[0] if len(model) else None)
            return pd.concat([pd.DataFrame(columns=names), *rows_of([blocks], lambda group: table)], ignore_index=True)

        rest = blocks.join(F.broadcast(self.parts), "group").withColumn("part", F.pmod(F.hash("block"), F.col("parts"))).drop("parts")
        return out.unionByName(rest.groupBy("group", "part").cogroup(self.rows.groupBy("group", "part")).applyInPandas(one, kind))


def quality_rules(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, low, high, kept.

    Each language has a modified Kneser-Ney model of its own, over all runs of ORDER symbols of its usual documents. It is trained on these
    alone, so that junk doesn't predict itself: a first model of shorter runs counts in how many of the documents that pass the base rules a
    run occurs; those whose mean of squared log p under it is within a fence of the language's quartiles are usual. Of equal texts one is
    trained on. The model is never in one place: texts are kept in blocks, a block's different runs go to the slices of the model that hold
    their contexts, where counts are added up, discounted and turned into probabilities, and these go back to the block. log_perplexity is
    the mean of -log p over a text's runs. The bands are fences around the quartiles of the documents of the language that pass the base rules, from all such documents.
    kept: passes the base rules and is inside the band.
    Null texts count as empty (and fail); a null lang is a language of its own; a language with one document has a band of one value,
    which that document is inside of. Repeated rows are judged alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("none"))
    grouped = docs.select("doc_id", "lang", "text", group.alias("group"))
    sizes = materialize(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "languages")
    largest = [r["group"] for r in sizes.orderBy(F.desc("n"), "group").limit(MOST_SHARED + 1).collect()]  # MOST_SHARED + 1 rows
    common = largest[:MOST_SHARED]
    parts = sizes.where(~F.col("group").isin(common)).select("group", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")) if len(largest) > MOST_SHARED else None

    def bounds(values: DataFrame, column: str) -> DataFrame:
        q = values.groupBy(F.col("group").alias("band")).agg(F.percentile_approx(column, F.array(F.lit(0.25), F.lit(0.75)), 10000).alias("q"))
        wide = (F.col("q")[1] - F.col("q")[0]) * fence
        return F.broadcast(q.select("band", (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high")))  # a row a language

    most = BLOCK
    blocks, name = _kept_blocks(grouped.mapInPandas(lambda batches: _blocks(batches, most), _BLOCKS))
    try:
        first = Models(blocks.mapInPandas(_texts_with, _COUNTS).groupBy("group", "code").agg(F.sum("n").alias("n")), common, parts)
        surprise = materialize(first.apply(blocks, _surprises, _SURPRISE), "surprise")
        usual = surprise.join(bounds(surprise, "surprise"), F.col("group") == F.col("band")).where(F.col("surprise") <= F.col("high"))
        training = usual.groupBy("group", "key").agg(F.min(F.struct("block", "place")).alias("one")).groupBy("one.block").agg(F.collect_list("one.place").alias("places"))
        slices = materialize(blocks.groupBy("group").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("slices")), "slices")
        sliced = blocks.join(F.broadcast(slices), "group")
        wanted = materialize(sliced.groupBy("block").cogroup(training.groupBy("block")).applyInPandas(_wanted, _WANTED), "wanted", "uncompressed")
        statistics = wanted.groupBy("group", "slice").applyInPandas(_statistics, "group string, size int, code long, n long").groupBy("group", "size", "code").agg(F.sum("n").alias("n"))
        shared = statistics.groupBy("group").applyInPandas(_shared, "group string, shared binary").join(F.broadcast(slices), "group")
        shared = shared.select("group", "shared", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        answers = wanted.groupBy("group", "slice").cogroup(shared.groupBy("group", "slice")).applyInPandas(_answers, _ANSWERS)
        scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scores, _SCORES)
        scored = materialize(scored, "perplexity")
    finally:
        spark.sql(f"DROP TABLE {name}")
    remove(blocks, wanted)
    joined = scored.join(bounds(scored.where(~F.col("base_failed")), "log_perplexity"), F.col("group") == F.col("band"), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.select(*[n for n in _NAMES if n != "group"], "low", "high", (~F.col("base_failed") & inside).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules of all documents: null and empty texts fail the base rules, a null lang is a language, repeated rows and ties are judged
    alike, an empty table gives no rows, other columns aren't read."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("lang")
