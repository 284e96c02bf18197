"""Token ids in compressed binary files: canonical length-limited Huffman codes, blocks that decode by themselves.

A file holds, little-endian: the magic word; its place in the order of files; counts of documents, ids, blocks, payload words and bytes of
the packed code lengths; these; document ids and sizes; the bit offset at which each block begins; the code bits in big-endian 64-bit
words; a line feed, which readers skip. Spark's own text writer writes them, whole rows of bytes, so that they reach any store that Spark
reaches and only whole files are committed.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, materialize, remove, shared_dir, table, texts_of
from .tokens import ids_of

TOKENIZER, END = "word_bpe_49k.json", 2
MAGIC, BLOCK, LONGEST, IDS_A_FILE = b"IDHUFF02", 512, 16, 1 << 22
_HEAD = struct.Struct("<8sQQQQQQ")
_NULL = np.iinfo(np.int64).min


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code in which none is over `longest` bits (package-merge); 0 for what never occurs."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols don't fit into {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    single, packs = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate((leaves, packs))
        order = np.argsort(both, kind="stable")
        single.append(order < len(leaves))
        both = both[order][: len(both) // 2 * 2]
        packs = both[::2] + both[1::2]
    take = 2 * len(leaves) - 2
    for flags in reversed(single):
        own = int(flags[:take].sum())
        lengths[used[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= n - before
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, before = code + len(own), n
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The code bits of ids in 64-bit words, and the bit offset of every block of ids."""
    sizes = lengths[ids]
    total = int(sizes.sum(dtype=np.int64))
    words, marks, base = np.zeros(total // 64 + 2, np.uint64), [], 0
    step = block * 1024
    for at in range(0, len(ids), step):
        size = sizes[at : at + step].astype(np.int64)
        offset = base + np.cumsum(size) - size
        marks.append(offset[::block])
        base = int(offset[-1] + size[-1])
        code, word, end = codes[ids[at : at + step]], offset >> 6, (offset & 63) + size
        over = np.maximum(end - 64, 0).astype(np.uint64)
        high = (code >> over) << np.maximum(64 - end, 0).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(high, first)
        split = np.flatnonzero(over)
        words[word[split] + 1] |= code[split] << (np.uint64(64) - over[split])
    return words, np.concatenate(marks) if marks else np.zeros(0, np.int64)


def decode(words: np.ndarray, marks: np.ndarray, n: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids again. Every block starts at its own mark, so all go forward together, a table look-up a step."""
    longest = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (longest - lengths[used].astype(np.int64))
    symbol, width = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.int64)
    symbol[: spans.sum()] = np.repeat(used, spans)
    width[: spans.sum()] = np.repeat(lengths[used], spans)
    at, last = marks.astype(np.int64), len(words) - 2
    out = np.empty((block, len(at)), np.uint32)
    for k in range(min(block, n)):
        word, bit = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
        seen = (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
        key = (seen >> np.uint64(64 - longest)).astype(np.int64)
        out[k] = symbol[key]
        at = at + width[key]
    return out.T.reshape(-1)[:n]


def pack_file(file: int, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, marks = encode(ids, lengths, codes)
    table_ = zlib.compress(lengths.tobytes())
    head = _HEAD.pack(MAGIC, file, len(doc_ids), len(ids), len(marks), len(words), len(table_))
    return b"".join((head, table_, doc_ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), marks.astype("<u8").tobytes(), words.astype(">u8").tobytes()))


def head_of(data: bytes) -> tuple[int, int, int, int, int, int]:
    """A file's place, and its counts of documents, ids, blocks, payload words and bytes of code lengths."""
    magic, *head = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    return tuple(head)


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, sizes and all ids of a file."""
    _, docs, n, blocks, words, size = head_of(data)
    lengths = np.frombuffer(zlib.decompress(data[_HEAD.size : _HEAD.size + size]), np.uint8)
    at = _HEAD.size + size
    parts = []
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u8", blocks), (">u8", words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += 8 * count
    return parts[0], parts[1].astype(np.int64), decode(parts[3].astype(np.uint64), parts[2], n, lengths)


def token_table(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """doc_id, row_key, n_tokens and ids (two bytes each, four if the vocabulary needs it) with the end id."""

    def run(batches):
        tok = ids_of(tokenizer)
        width = 2 if max(tok.tok.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for part in chunks(batches):
            ids, sizes = tok.encode(texts_of(part["text"]), end)
            raw, edge = ids.astype(f"<u{width}").tobytes(), (np.cumsum(sizes) * width).tolist()
            own = [raw[a:b] for a, b in zip([0, *edge], edge, strict=False)]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "row_key": part["row_key"].array, "n_tokens": sizes, "ids": own})

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInPandas(run, "doc_id long, row_key long, n_tokens long, ids binary")


def _flat(batch: pd.DataFrame) -> np.ndarray:
    """The ids of all documents of a batch after each other."""
    total = int(batch["n_tokens"].sum())
    raw = b"".join(batch["ids"])
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4")


def global_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all documents; every task sends one row an id at most."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            got = np.bincount(_flat(batch))
            if len(got) > len(total):
                total = np.concatenate((total, np.zeros(len(got) - len(total), np.int64)))
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    return tokens.select("n_tokens", "ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END, ids_a_file: int = IDS_A_FILE) -> None:
    """Writes all documents' ids to files in the new `folder` (of any store that Spark writes to), in ascending doc_id order, nulls first.

    The documents are dealt out by ranges of doc_id, one file a range. Repeated rows are written as often as they are there, null texts
    are the end id alone, other columns aren't read. The one thing that comes to the driver is a count for each id of the vocabulary.
    Without documents there are no files, and the folder is empty.
    """
    tokens = materialize(token_table(docs, tokenizer, end), "ids-tokens", "zstd")
    found = global_counts(tokens).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"]] = found["n"]
    lengths = code_lengths(counts, max(LONGEST, (max(len(found), 1) - 1).bit_length()))
    codes = canonical_codes(lengths)
    files = max(1, -(-int(counts.sum()) // ids_a_file))

    def store(batches):
        doc_ids, sizes, ids = [], [], []
        for batch in batches:
            doc_ids.append(batch["doc_id"].astype("Int64").fillna(_NULL).to_numpy(np.int64))
            sizes.append(batch["n_tokens"].to_numpy(np.int64))
            ids.append(_flat(batch))
        if doc_ids:
            yield pd.DataFrame({"content": [pack_file(TaskContext.get().partitionId(), *map(np.concatenate, (doc_ids, sizes, ids)), lengths, codes)]})

    # ranges of rows, not of ids: many rows with one id, or none, are many files
    first = F.col("doc_id").asc_nulls_first()
    dealt = tokens.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, first, "row_key", "row").sortWithinPartitions(first, "row_key").drop("row")
    dealt.mapInPandas(store, "content binary").select(F.col("content").cast("string")).write.text(folder)  # the cast leaves the bytes as they are
    remove(tokens)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of the files of `folder`: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of ids as unsigned 32-bit), and ids if asked for."""
    kind = "file long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def load(batches):
        for batch in batches:
            for content in batch["content"]:
                doc_ids, sizes, ids = unpack_file(content)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out = pd.DataFrame({"file": head_of(content)[0], "doc_id": pd.array(doc_ids, "Int64"), "inside": ends - sizes, "n_tokens": sizes, "ids_crc32": crcs})
                out.loc[doc_ids == _NULL, "doc_id"] = pd.NA
                yield out.assign(ids=np.split(ids.astype(np.int32), ends[:-1])) if with_ids else out

    def heads(batches):
        for batch in batches:
            yield pd.DataFrame([(h[0], h[2]) for h in map(head_of, batch["content"])], columns=["file", "n_ids"])

    contents = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("content")
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = contents.select(F.substring("content", 1, _HEAD.size).alias("content")).mapInPandas(heads, "file long, n_ids long")
    starts = sizes.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))  # a row a file
    return contents.mapInPandas(load, kind).join(starts, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are the end id alone; equal rows are written as often as they are there; an empty table gives no rows."""
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder)
