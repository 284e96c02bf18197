"""From raw JSON lines to typed records: lenient parsing, paths, times, declarative mappings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that hold a JSON object, with it as `obj` (variant); blank, broken and other lines go."""
    rows = lines.withColumn("obj", F.try_parse_json(F.trim(line)))
    return rows.where(F.col("obj").isNotNull() & F.expr("schema_of_variant(obj)").startswith("OBJECT"))


def at(obj: str | Column, path: str, kind: str = "string") -> Column:
    """The value at a dot path (parts of digits are list places); null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(F.col(obj) if isinstance(obj, str) else obj, f"${steps}", kind)


def timestamp(value: Column, fallback: Column) -> Column:
    """Seconds, milliseconds (over 1e12) or nanoseconds (over 1e15) since 1970, or ISO text; else the fallback."""
    number = value.try_cast("double")
    seconds = F.when(number > 1e15, number / 1e9).when(number > 1e12, number / 1e3).otherwise(number)
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros((seconds * 1e6).cast("long"))), F.try_to_timestamp(value), fallback)


@dataclass(frozen=True)
class Mapping:
    """How records of a framework become events: the field that tells the type, the kind for each type, the kind otherwise (none drops the
    record), payload fields by dot path or `literal:`, and where the session and the time are."""

    framework: str
    type_path: str
    kinds: dict[str, str]
    default_kind: str = ""
    payload: dict[str, str] = field(default_factory=dict)
    session_path: str = "session_id"
    time_path: str = "timestamp"


def mapped(records: DataFrame, mapping: Mapping, received: Column | None = None) -> DataFrame:
    """kind, session_id, ts, payload (map; null values left out), original_type where the kind is the default one."""
    kind_of = F.create_map(*[F.lit(x) for pair in mapping.kinds.items() for x in pair])
    raw = at("obj", mapping.type_path)
    known = F.try_element_at(kind_of, raw)
    value = lambda p: F.lit(p.removeprefix("literal:")) if p.startswith("literal:") else at("obj", p)
    payload = F.map_filter(F.create_map(*[x for n, p in mapping.payload.items() for x in (F.lit(n), value(p))]), lambda _, v: v.isNotNull())
    rows = records.withColumns({"kind": F.coalesce(known, F.lit(mapping.default_kind or None)), "original_type": F.when(known.isNull(), raw)})
    when = timestamp(at("obj", mapping.time_path), received if received is not None else F.lit(None).cast("timestamp"))
    return rows.where(F.col("kind").isNotNull()).withColumns({"session_id": at("obj", mapping.session_path), "ts": when, "payload": payload})


def attributes(pairs: Column) -> Column:
    """An OpenTelemetry list of {key, value:{xValue}} as a map: the first value that is there."""
    first = lambda v: F.coalesce(*[v[c] for c in ("stringValue", "intValue", "doubleValue", "boolValue")])
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), first(p["value"]).alias("value"))))


#: A JSON string with what makes it a key, if anything does. Possessive, so that a long string costs neither stack nor a second look.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'


def string_leaves(json: Column) -> Column:
    """The strings among the values of a JSON text, at any depth, in order of the text, keys left out; null for what isn't JSON.

    Escapes are resolved. Numbers, booleans and nulls give nothing; a bare string gives itself. A text in which an object repeats a key isn't
    taken for JSON.
    """
    found = F.filter(F.regexp_extract_all(json, F.lit(_STRING), F.lit(0)), lambda s: F.endswith(s, F.lit('"')))
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>"))


def flat_text(motivation: Column, payload: Column, most_chars: int | None = None) -> Column:
    """What there is to read on an event: its motivation and the strings of its payload, by spaces, cut to most_chars where that is asked for.

    A payload that isn't JSON is read as it is; empty strings leave no space; nulls are nothing, and nothing at all is an empty text.
    """
    parts = F.concat(F.array(motivation), F.coalesce(string_leaves(payload), F.array(payload)))
    text = F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(" \t\n\r"))
    return text if most_chars is None else F.substring(text, 1, most_chars)
