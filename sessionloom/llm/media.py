"""Copies of images, cropped or edited, by local descriptors: corners at several scales, oriented binary tests, Hamming tables, geometry."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Corners kept at each scale (the image, and half of it); tests in a descriptor. A table for each half of the tests: its key is the
#: first KEY tests of the half.
CORNERS, TESTS, KEY = (24, 6), 128, 48
#: Distance of a test's points from the corner, and of corners from the border.
REACH, TURNS = 8, 16
#: Corners that must agree on one turn, doubling and shift; the shift's tolerance in pixels; how many of REST tests of the
#: other half may differ where a key is shared.
LEAST_CORNERS, SHIFT, REST, MOST_BITS = 3, 4, 27, 7
_HEAD = np.dtype("<u2")


def encode_image(pixels: np.ndarray) -> bytes:
    """Height, width and grey values."""
    return np.array(pixels.shape, _HEAD).tobytes() + pixels.astype(np.uint8).tobytes()


def decode_image(data: bytes | None) -> np.ndarray:
    """The grey values; an image of nothing for null or broken bytes."""
    if data is None or len(data) < 4:
        return np.zeros((0, 0), np.uint8)
    h, w = np.frombuffer(data, _HEAD, 2)
    return np.frombuffer(data, np.uint8, offset=4).reshape(h, w) if len(data) == 4 + int(h) * int(w) else np.zeros((0, 0), np.uint8)


def _stretch(side: int, cells: int) -> np.ndarray:
    """Linear interpolation from cells to pixels, as a matrix."""
    at = np.linspace(0, cells - 1, side)
    low = np.minimum(at.astype(int), cells - 2)
    out = np.zeros((side, cells), np.float32)
    out[np.arange(side), low], out[np.arange(side), low + 1] = 1 - (at - low), at - low
    return out


_SIDE = 64
_CELLS = 32
_STRETCH = _stretch(_SIDE, _CELLS)


def render(text: str) -> np.ndarray:
    """An image that depends on the whole of a text: soft noise and rectangles."""
    raw = text.encode("utf-8", "surrogatepass")
    rng = np.random.Generator(np.random.PCG64(zlib.crc32(raw) << 32 | zlib.adler32(raw)))
    draws = rng.random(_CELLS * _CELLS + 40, np.float32)
    out = _STRETCH @ (40 + 170 * draws[:-40].reshape(_CELLS, _CELLS)) @ _STRETCH.T
    for y, x, h, w, g in (draws[-40:].reshape(8, 5) * (_SIDE - 8, _SIDE - 8, 20, 20, 255)).tolist():
        own = out[int(y) : int(y + h) + 5, int(x) : int(x + w) + 5]
        own *= 0.6
        own += 0.4 * g
    return np.clip(out, 0, 255).astype(np.uint8)


def edited(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A cropped copy, with other brightness and contrast, a patch painted over, and turned by quarters."""
    rng = np.random.default_rng(seed)
    h, w = pixels.shape
    y, x = rng.integers(0, h // 4 + 1), rng.integers(0, w // 4 + 1)
    out = pixels[y : y + h * 3 // 4, x : x + w * 3 // 4].astype(np.float32) * rng.uniform(0.8, 1.1) + rng.uniform(-10, 10)
    py, px = rng.integers(0, out.shape[0] - 8), rng.integers(0, out.shape[1] - 8)
    out[py : py + 8, px : px + 8] = rng.integers(0, 255)
    return np.clip(np.rot90(out, rng.integers(0, 4)), 0, 255).astype(np.uint8)


def _pattern() -> np.ndarray:
    """Offsets of the tests' two points for each turn: (turn, test, point, yx)."""
    rng = np.random.default_rng(20)
    points = rng.uniform(-REACH * 0.75, REACH * 0.75, (TESTS, 2, 2))
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], -1), np.stack([-np.sin(angle), np.cos(angle)], -1)], -2)
    return np.clip(np.rint(np.einsum("tij,kpj->tkpi", turn, points)), -REACH, REACH).astype(np.int64)


_TESTS = _pattern()
_DISC = np.array([(y, x) for y in range(-REACH, REACH + 1) for x in range(-REACH, REACH + 1) if y * y + x * x <= REACH * REACH])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square around each pixel; the border repeats."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        cut = (lambda k: wide[:, k : k + n]) if axis == 1 else (lambda k: wide[:, :, k : k + n])  # noqa: B023
        a = cut(0).copy()
        for k in range(1, 2 * r + 1):
            a += cut(k)  # noqa: B023
        a /= 2 * r + 1
    return a


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equally large images: which image each corner is in, its y and x in the image, turn and level, and the bits of its descriptor (0 or 1)."""
    who, where, bits = [], [], []
    level, scale = images.astype(np.float32), 1
    for most in CORNERS:
        if min(level.shape[1:]) <= 2 * REACH + 4:
            break
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gy * gy, 2), _box(gy * gx, 2), _box(gx * gx, 2)
        r = a * c - b * b - 0.05 * (a + c) ** 2
        edge = REACH + 1
        top = r.copy()
        np.maximum(top[:, 1:-1], np.maximum(r[:, 2:], r[:, :-2]), out=top[:, 1:-1])
        side = top.copy()
        np.maximum(top[:, :, 1:-1], np.maximum(side[:, :, 2:], side[:, :, :-2]), out=top[:, :, 1:-1])
        flat = np.zeros_like(r)
        inner = (slice(None), slice(edge, -edge), slice(edge, -edge))
        flat[inner] = np.where((r[inner] >= top[inner]) & (r[inner] > 1), r[inner], 0)
        flat = flat.reshape(len(r), -1)
        best = np.argpartition(-flat, most, 1)[:, :most]
        i = np.repeat(np.arange(len(r)), most)
        y, x = np.divmod(best.ravel(), r.shape[2])
        keep = flat[i, best.ravel()] > 0
        i, y, x = i[keep], y[keep], x[keep]
        if len(i):
            disc = smooth[i[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
            angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
            turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            t = _TESTS[turn]
            p = smooth[i[:, None, None], y[:, None, None] + t[..., 0], x[:, None, None] + t[..., 1]]
            who.append(i)
            where.append(np.column_stack([y * scale, x * scale, turn, np.full(len(y), scale // 2)]))
            bits.append((p[..., 0] < p[..., 1]).astype(np.uint8))
        h, w = (n // 2 * 2 for n in level.shape[1:])
        level = (level[:, :h:2, :w:2] + level[:, 1:h:2, :w:2] + level[:, :h:2, 1:w:2] + level[:, 1:h:2, 1:w:2]) / 4
        scale *= 2
    if not who:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros((0, TESTS), np.uint8)
    return np.concatenate(who), np.concatenate(where), np.concatenate(bits)


def corners(images: DataFrame) -> DataFrame:
    """id, image_key (128 bits of hash of the image), and of each corner of image (id, image): place and the two halves of the descriptor,
    as arrays at, a, b. A place is level, turn, y and x in 1, 4, 16 and 16 bits."""

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 128):
                part = batch.iloc[low : low + 128]
                pixels = [decode_image(d) for d in part["image"]]
                nothing = np.zeros(0, np.int64)
                found = [(nothing, nothing, nothing) for _ in pixels]
                for shape in {p.shape for p in pixels if p.size}:
                    own = [k for k, p in enumerate(pixels) if p.shape == shape]
                    who, where, bits = describe(np.stack([pixels[k] for k in own]))
                    half = np.packbits(bits, axis=1).reshape(len(bits), 2, TESTS // 16).copy().view(">i8")[..., 0].astype(np.int64)
                    at = where[:, 3] << 36 | where[:, 2] << 32 | where[:, 0] << 16 | where[:, 1]
                    order = np.argsort(who, kind="stable")
                    ends = np.searchsorted(who[order], np.arange(len(own) + 1))
                    for k, lo, hi in zip(own, ends[:-1], ends[1:], strict=True):
                        found[k] = tuple(v[order[lo:hi]] for v in (at, half[:, 0], half[:, 1]))
                yield pd.DataFrame({"id": part["id"].astype("Int64").array, "image_key": part["image_key"].array} | {c: [f[i] for f in found] for i, c in enumerate(("at", "a", "b"))})

    schema = "id long, image_key binary, at array<bigint>, a array<bigint>, b array<bigint>"
    return images.select("id", F.unhex(F.substring(F.sha2(F.coalesce("image", F.lit(b"")), 256), 1, 32)).alias("image_key"), "image").mapInPandas(run, schema)


def _entries(images: DataFrame, name: str, prefix: str) -> DataFrame:
    """What each corner puts into the two tables: key, its image, and in one number REST other tests for the distance and the place."""
    each = images.select(F.col(name).alias(f"{prefix}_id"), F.explode(F.arrays_zip("at", "a", "b")).alias("c"))
    of = lambda own, other, n: F.struct(
        (F.shiftleft(F.shiftrightunsigned(own, 64 - KEY), 1) + n).alias("key"), F.shiftleft(F.shiftrightunsigned(other, 64 - REST), 64 - REST).bitwiseOR(F.col("c.at")).alias(prefix)
    )
    return each.select(f"{prefix}_id", F.explode(F.array(of("c.a", "c.b", 0), of("c.b", "c.a", 1))).alias("e")).select(f"{prefix}_id", "e.*")


def _place(name: str) -> tuple:
    """y, x, turn and level out of an entry's number."""
    part = lambda low, bits: F.shiftrightunsigned(name, low).bitwiseAND((1 << bits) - 1).cast("int")
    return part(16, 16), part(0, 16), part(32, 4), part(36, 1)


def find_copies(queries: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, members) for queries and images of (id, image).

    Equal images are one class: members has id, class_id (the class's least id, not unique where ids repeat or are null) and class_key
    (the class's own) of all images. matches has a row for each query and class that is a cropped or edited form of the other: query_id,
    class_id, class_key, corners (that agree), turn (in TURNS steps from the query to the class), octave (the class's image is 2 ** octave
    times as large: -1, 0, 1), dy, dx (the shift after both). Corners that share a key in one of the two tables are compared by the Hamming
    distance of other tests; each pair that is near votes for the turn and the doubling in which the corners' directions and levels differ
    and the shift that is left, and LEAST_CORNERS must agree. Images without corners (flat, small, null, broken) match nothing; repeated
    rows are members of one class; queries with the same id and image are one query. Every image is indexed, every table looked up as a
    join; only classes go into it, so copies of any number are one entry.
    """
    found = materialize(corners(images), "media-images", "zstd")
    # written with their numbers: what later jobs join on is a number of eight bytes, and the same in each of them
    numbered = found.groupBy("image_key").agg(F.min("id").alias("class_id")).withColumn("class_no", F.monotonically_increasing_id())
    classes = materialize(numbered, "media-classes")
    members = found.select("id", "image_key").join(classes, "image_key").select("id", "class_id", F.hex("image_key").alias("class_key"))
    # copies meet before the shuffle, so that an image which many rows have isn't sent as often; equal images have equal corners
    firsts = found.groupBy("image_key").agg(F.first(F.struct("at", "a", "b")).alias("c")).join(classes.select("image_key", "class_no"), "image_key").select("class_no", "c.*")
    asked = materialize(corners(queries).dropDuplicates(["id", "image_key"]).withColumn("query_no", F.monotonically_increasing_id()), "media-queries")
    met = _entries(asked, "query_no", "q").join(_entries(firsts, "class_no", "i").hint("merge"), "key")
    differ = F.shiftrightunsigned(F.col("q").bitwiseXOR(F.col("i")), 64 - REST)
    (qy, qx, q_turn, q_level), (iy, ix, i_turn, i_level) = _place("q"), _place("i")
    near = met.where(F.bit_count(differ) <= MOST_BITS)
    # pairs of images with too few corners to agree go before any geometry; an image's corners bound a list
    pairs = near.groupBy("q_id", "i_id").agg(F.collect_list(F.struct("q", "i")).alias("met"))
    place = lambda c: c["q"].bitwiseAND((1 << 64 - REST) - 1)
    pairs = pairs.where(F.size(F.array_distinct(F.transform("met", place))) >= LEAST_CORNERS)
    near = pairs.select("q_id", "i_id", F.explode("met").alias("m")).select("q_id", "i_id", "m.q", "m.i")
    near = near.select("q_id", "i_id", F.col("q").bitwiseAND((1 << 64 - REST) - 1).alias("q_at"), qy.alias("qy"), qx.alias("qx"), iy.alias("iy"), ix.alias("ix"), F.pmod(i_turn - q_turn, F.lit(TURNS)).alias("turn"), (i_level - q_level).alias("octave"))
    size, angle = F.pow(F.lit(2.0), F.col("octave")), F.col("turn") * (2 * np.pi / TURNS)
    near = near.withColumns({"dy": F.col("iy") - size * (F.col("qy") * F.cos(angle) + F.col("qx") * F.sin(angle)), "dx": F.col("ix") - size * (F.col("qx") * F.cos(angle) - F.col("qy") * F.sin(angle))})
    # two grids of shifts, half a cell apart, so that shifts which are near each other share a cell
    cells = near.withColumn("grid", F.explode(F.array(F.lit(0), F.lit(SHIFT // 2))))
    cells = cells.withColumns({"cy": F.floor((F.col("dy") + F.col("grid")) / SHIFT), "cx": F.floor((F.col("dx") + F.col("grid")) / SHIFT)})
    agree = cells.groupBy("q_id", "i_id", "turn", "octave", "grid", "cy", "cx").agg(F.count_distinct("q_at").alias("corners"), F.round(F.avg("dy")).cast("int").alias("dy"), F.round(F.avg("dx")).cast("int").alias("dx"))
    best = agree.where(F.col("corners") >= LEAST_CORNERS).groupBy("q_id", "i_id").agg(F.max(F.struct("corners", "turn", "octave", "dy", "dx")).alias("best"))
    named = best.join(asked.select(F.col("query_no").alias("q_id"), F.col("id").alias("query_id")), "q_id")
    named = named.join(classes.select(F.col("class_no").alias("i_id"), "class_id", F.hex("image_key").alias("class_key")), "i_id")
    return named.select("query_id", "class_id", "class_key", "best.*"), members


def media_of(docs: DataFrame, copies: bool = False) -> DataFrame:
    """A column of media for the documents: an image of each whole text, or with `copies` a cropped and edited form of it."""

    def run(batches):
        for part in batches:
            pixels = [render(t if isinstance(t, str) else "") for t in part["text"]]
            if copies:
                pixels = [edited(p, int(k) & 0xFFFFFFFF) for p, k in zip(pixels, part["id"].fillna(0), strict=True)]
            yield pd.DataFrame({"id": part["id"].astype("Int64").array, "image": [encode_image(p) for p in pixels]})

    return docs.select(F.col("doc_id").alias("id"), "text").mapInPandas(run, "id long, image binary")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind 'match': an edited copy of the image of doc_id (each one divisible by 20) and the class it was found to be a copy of; kind
    'member': all documents whose image others have too, and their class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    matches, members = find_copies(media_of(docs.where(F.col("doc_id") % 20 == 0), copies=True), media_of(docs))
    several = members.groupBy("class_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_key")
    found = matches.select(F.lit("match").alias("kind"), F.col("query_id").alias("doc_id"), "class_id", "class_key", F.col("corners").cast("long"), "dy", "dx", "turn", "octave")
    nothing = F.lit(None)
    own = members.join(several, "class_key", "left_semi").select(F.lit("member").alias("kind"), F.col("id").alias("doc_id"), "class_id", "class_key", nothing.cast("long").alias("corners"), *(nothing.cast("int").alias(c) for c in ("dy", "dx", "turn", "octave")))
    return found.unionByName(own)
