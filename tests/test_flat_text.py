"""Strings of nested payloads against a walk in Python."""

import json
import random

from pyspark.sql import functions as F

from sessionloom.functions import records


def walk(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from walk(v)


def plain(motivation, payload, most):
    parts = [motivation]
    if payload is not None:
        try:
            parts += walk(json.loads(payload))
        except json.JSONDecodeError:
            parts.append(payload)
    return " ".join(p for p in parts if p).strip(" \t\n\r")[:most]


def made(rng, depth=0):
    text = lambda: "".join(rng.choice(['a', ' ', '"', '\\', ':', '{', ',', '\n', 'é', '😀', '/']) for _ in range(rng.randrange(6)))
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 3:
        return text()
    if kind == 3:
        return rng.choice([None, True, 3, -0.5, 10**12])
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {text() + str(i): made(rng, depth + 1) for i in range(rng.randrange(4))}


def test_flat_text_is_the_walk(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "why"]), json.dumps(made(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) for i in range(300)]
    odd = [None, "", "not json", '{"a": "cut', '"bare"', "[]", '{"a" : "b"}', '{"a":[{"b":"c"},"d"],"e":{"f":"g"}}', json.dumps({"long": "x\\\"" * 200_000}), json.dumps(["y" * 500_000])]
    rows += [(1000 + i, "m", p) for i, p in enumerate(odd)]
    table = spark.createDataFrame(rows, "id int, motivation string, payload string")
    for most in (None, 2000):
        got = {r.id: r.t for r in table.select("id", records.flat_text(F.col("motivation"), F.col("payload"), most).alias("t")).collect()}
        for key, motivation, payload in rows:
            assert got[key] == plain(motivation, payload, most), payload[:200] if payload else payload


def test_a_repeated_key_is_no_json(spark):
    rows = spark.createDataFrame([('{"a":"x","a":"y"}',)], "p string")
    assert rows.select(records.flat_text(F.lit(None).cast("string"), F.col("p"))).first()[0] == '{"a":"x","a":"y"}'
