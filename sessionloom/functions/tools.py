"""Names, classes and effects of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known tools with mechanism, effect and capabilities.
KNOWN = {
    "bash": ("shell", "mutating", ("subprocess",)),
    "read_file": ("native", "read_only", ()),
    "write_file": ("native", "mutating", ()),
    "grep": ("native", "read_only", ()),
    "web_search": ("native", "read_only", ("network_outbound",)),
    "edit_file": ("native", "mutating", ()),
    "list_dir": ("native", "read_only", ()),
}
#: Verbs at the start of a name and their effects; the first that fits holds.
VERBS = (
    ("get", "read_only"), ("list", "read_only"), ("read", "read_only"), ("search", "read_only"), ("query", "read_only"), ("fetch", "read_only"),
    ("create", "mutating"), ("update", "mutating"), ("write", "mutating"), ("set", "mutating"), ("add", "mutating"),
    ("delete", "destructive"), ("remove", "destructive"), ("drop", "destructive"), ("purge", "destructive"),
)
SEVERITY = ("read_only", "mutating", "destructive")


def normalized(tool: Column) -> Column:
    """Without the server's prefix, in lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(tool, "^mcp__[A-Za-z0-9]+__", "")), "-", "_")


def verb_effect(name: Column) -> Column:
    rules = [F.when((name == v) | name.startswith(f"{v}_"), e) for v, e in VERBS]
    return F.coalesce(*rules)


def permission_effect(kind: Column) -> Column:
    """Null for kinds that aren't known."""
    return F.when(kind == "read", "read_only").when(kind.isin("write", "shell"), "mutating")


def classify(calls: DataFrame) -> DataFrame:
    """Adds name, mechanism, effect, capability: the table of known tools, else the verb at the start of the name. The table is a literal of
    a few entries, so this stays one projection without a join."""
    entry = F.create_map(*[x for n, (m, e, c) in KNOWN.items() for x in (F.lit(n), F.struct(F.lit(m).alias("mechanism"), F.lit(e).alias("effect"), F.array(*map(F.lit, c)).cast("array<string>").alias("capability")))])
    known = calls.withColumn("name", normalized(F.col("tool"))).withColumn("known", F.try_element_at(entry, F.col("name")))
    mechanism = F.when(F.col("tool").startswith("mcp__"), "mcp").when(F.col("known").isNotNull(), "native").otherwise("unknown")
    return known.withColumns({"mechanism": mechanism, "effect": F.coalesce(F.col("known.effect"), verb_effect(F.col("name"))), "capability": F.coalesce(F.col("known.capability"), F.array().cast("array<string>"))}).drop("known")


def display(tool: Column) -> Column:
    name = normalized(tool)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.regexp_replace(F.substr(name, F.lit(2)), "_", " "))


def is_a(path: Column, ancestor: Column) -> Column:
    return (path == ancestor) | path.startswith(F.concat(ancestor, F.lit(".")))


def descendants(paths: DataFrame) -> DataFrame:
    """ancestor, path for each root of dot-paths and all below it: the root is the first part, so no join is needed."""
    return paths.select(F.substring_index("path", ".", 1).alias("ancestor"), "path")


def worst(effects: Column) -> Column:
    """The most severe of an array of effects."""
    ranks = F.transform(effects, lambda e: F.array_position(F.array(*map(F.lit, SEVERITY)), e))
    return F.try_element_at(F.array(*map(F.lit, SEVERITY)), F.array_max(ranks).cast("int"))
