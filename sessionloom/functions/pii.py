"""Personal data in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
PATTERNS = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: Card numbers: 13 to 19 digits together, or in the groups in which they are printed.
CARD = r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9])"


def redacted(text: Column) -> Column:
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def luhn(digits: Column) -> Column:
    """True where a string of digits has a right check digit: from the right, every second one doubled."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def card_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start (from 1), span for each place of a card-shaped number with a right check digit; a number that stands there twice has two rows.
    Null texts have none."""
    # the text is cut before every place where such a number could begin, so that other digits in front don't hide it
    cuts = F.split("text", rf"(?<![0-9])(?={CARD})", -1)
    places = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.explode(F.aggregate(cuts, F.array(F.lit(1)), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + F.length(part))))).alias("start"))
    found = places.select("doc_id", "start", F.regexp_extract(F.substring(F.col("text"), F.col("start"), F.lit(40)), f"^{CARD}", 0).alias("span")).where("span <> ''").distinct()
    return found.where(luhn(F.regexp_replace("span", "[ -]", "")))
