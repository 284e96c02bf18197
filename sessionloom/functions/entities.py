"""Entities of personal data in texts: where they are, how sure that is, and what to do with the text."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entity, name of the pattern, pattern (case is ignored), score.
PATTERNS = [
    ("CREDIT_CARD", "visa", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.5),
    ("CREDIT_CARD", "mastercard", r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.5),
    ("CREDIT_CARD", "amex", r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b", 0.5),
    ("CREDIT_CARD", "discover", r"\b6(?:011|5\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.5),
    ("CREDIT_CARD", "generic_16", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.3),
    ("US_SSN", "ssn_dashes", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.85),
    ("US_SSN", "ssn_no_dashes", r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b", 0.3),
    ("EMAIL_ADDRESS", "email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.85),
    ("PHONE_NUMBER", "us_phone", r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", 0.4),
    ("PHONE_NUMBER", "intl_phone", r"\+\d{1,3}[\s\-.]?\d{1,4}[\s\-.]?\d{2,4}[\s\-.]?\d{2,4}(?:[\s\-.]?\d{2,4})?", 0.4),
    ("IP_ADDRESS", "ipv4", r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.6),
    ("IP_ADDRESS", "ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.6),
    ("IBAN_CODE", "iban_generic", r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b", 0.5),
    ("US_PASSPORT", "us_passport", r"\b[A-Z]?\d{8,9}\b", 0.1),
    ("US_BANK_NUMBER", "us_routing", r"\b\d{9}\b", 0.05),
    ("CRYPTO", "btc_p2pkh", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 0.5),
    ("CRYPTO", "btc_bech32", r"\bbc1[a-z0-9]{39,59}\b", 0.7),
    ("CRYPTO", "eth", r"\b0x[0-9a-fA-F]{40}\b", 0.7),
    ("API_KEY", "openai_key", r"\bsk-[A-Za-z0-9]{20,}\b", 0.9),
    ("API_KEY", "github_pat", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", 0.95),
    ("API_KEY", "aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", 0.95),
    ("API_KEY", "aws_secret_key", r"\b[A-Za-z0-9/+=]{40}\b", 0.1),
    ("API_KEY", "azure_key", r"\b[A-Za-z0-9+/]{86}==\b", 0.6),
    ("API_KEY", "generic_bearer", r"\b(?:Bearer|token)\s+[A-Za-z0-9\-._~+/]+=*\b", 0.4),
    ("API_KEY", "slack_token", r"\bxox[baprs]-[0-9a-zA-Z\-]{10,}\b", 0.9),
    ("API_KEY", "stripe_key", r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{20,}\b", 0.95),
    ("URL", "url_http", r"""\bhttps?://[^\s<>"']{3,}\b""", 0.5),
]
#: Words of which one near a match makes it surer.
CONTEXT = {
    "CREDIT_CARD": ["credit", "card", "visa", "mastercard", "amex", "discover", "diners", "jcb", "maestro", "payment"],
    "US_SSN": ["social", "security", "ssn", "ss#", "social security", "taxpayer", "tin"],
    "EMAIL_ADDRESS": ["email", "mail", "e-mail", "address", "contact", "send", "to", "from", "cc", "bcc"],
    "PHONE_NUMBER": ["phone", "call", "tel", "telephone", "mobile", "cell", "fax", "contact", "dial", "number"],
    "IP_ADDRESS": ["ip", "address", "host", "server", "network", "subnet", "dns", "proxy"],
    "IBAN_CODE": ["iban", "bank", "account", "transfer", "swift", "bic", "wire", "payment"],
    "US_PASSPORT": ["passport", "travel", "document", "us passport", "state department"],
    "US_BANK_NUMBER": ["bank", "account", "routing", "aba", "checking", "savings", "wire", "ach"],
    "CRYPTO": ["bitcoin", "btc", "eth", "ethereum", "wallet", "crypto", "blockchain", "address"],
    "API_KEY": ["key", "token", "secret", "api", "bearer", "authorization", "auth", "credential", "password"],
    "URL": ["url", "link", "endpoint", "webhook", "redirect", "href", "src"],
}
#: Entities for which a text is suppressed; what is never personal; the gain by a word nearby, the characters searched for
#: it on either side; the loss by a wrong check digit; the least score.
CRITICAL = ["CREDIT_CARD", "US_SSN", "IBAN_CODE", "US_PASSPORT", "US_BANK_NUMBER", "API_KEY"]
ALLOWED = ["127.0.0.1", "0.0.0.0", "localhost", "::1", "255.255.255.255", "192.168.0.0", "10.0.0.0", "172.16.0.0", "example.com", "test@example.com", "noreply@github.com", "0000-0000-0000-0000"]
GAIN, NEARBY, LOSS, LEAST = 0.25, 50, 0.3, 0.5


def card_digits_fit(span: str) -> bool:
    """The check digit of a card number: every second digit from the right counts twice, the digits of the products are added."""
    digits = [int(c) for c in span if c.isdecimal()]
    return len(digits) >= 12 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def account_digits_fit(span: str) -> bool:
    """The check digits of a bank account: with its first four characters at the end and letters as 10 to 35 it leaves 1 modulo 97."""
    own = "".join(span.split())
    return len(own) >= 15 and own[:2].isalpha() and own[2:4].isdecimal() and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


CHECKED = {"CREDIT_CARD": card_digits_fit, "IBAN_CODE": account_digits_fit}


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span touches none of the taken ones, which are in order and apart from each other."""
    at = bisect_left(taken, (start, end))
    return not (at and taken[at - 1][1] > start) and not (at < len(taken) and taken[at][0] < end)


def spans_of(text: str, compiled: list, allowed: frozenset[str], least: float) -> list[tuple]:
    """(start, end, entity, pattern, score, span) of a text in order of place. Of spans that overlap, the one with the highest score stays,
    then the first, then the one whose pattern is named first."""
    found = []
    for rank, (entity, name, pattern, base) in enumerate(compiled):
        for m in pattern.finditer(text):
            span, (start, end) = m.group(), m.span()
            if span.lower() in allowed:
                continue
            near = text[max(0, start - NEARBY) : end + NEARBY].lower()
            score = min(1.0, base + GAIN) if any(w in near for w in CONTEXT.get(entity, ())) else base
            if entity in CHECKED:
                score = 1.0 if CHECKED[entity](span) else max(0.0, score - LOSS)
            if score >= least:
                found.append((-score, start, rank, end, entity, name, span))
    taken, kept = [], []
    for minus, start, _, end, entity, name, span in sorted(found):
        if _free(taken, start, end):
            insort(taken, (start, end))
            kept.append((start, end, entity, name, -minus, span))
    return sorted(kept)


def with_entities(docs: DataFrame, entities: Iterable[str] | None = None, least: float = LEAST, allowed: Iterable[str] = ()) -> DataFrame:
    """docs' doc_id and text with `found`: an array of start (from 0, in characters), end, entity, pattern, score, span, in order of place.

    entities: only these (None: all); allowed: more values that are no findings, whatever the case. A row for each row, nothing is
    shuffled; null and empty texts have none, repeated rows are scanned each, other columns aren't read.
    """
    wanted, more = None if entities is None else frozenset(entities), frozenset(v.lower() for v in [*ALLOWED, *allowed])
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        compiled = [(e, n, re.compile(p, re.IGNORECASE), s) for e, n, p, s in PATTERNS if wanted is None or e in wanted]
        names = ("start", "end", "entity", "pattern", "score", "span")
        for batch in batches:
            found = [[dict(zip(names, f, strict=True)) for f in spans_of(t, compiled, more, least)] if isinstance(t, str) else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "found": found})

    kind = "array<struct<start: int, end: int, entity: string, pattern: string, score: double, span: string>>"
    # ids as text, so that a null among them doesn't make them floats
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scan, f"doc_id string, text string, found {kind}")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def entity_spans(docs: DataFrame, **options) -> DataFrame:
    """A row for each finding: doc_id, start, end, entity, pattern, score, span."""
    return with_entities(docs, **options).select("doc_id", F.inline("found"))


def gate(docs: DataFrame, critical: Iterable[str] = CRITICAL, suppress: bool = True, **options) -> DataFrame:
    """A row for each document: doc_id, verdict, entities (distinct, in order), keys (what to mask, longest first), text after the verdict.

    'suppress' where a critical entity is found (no keys, null text), 'redact' where another is (every place of a key is masked), else
    'accept'. With suppress=False critical ones are masked as well. A null text is accepted and stays null.
    """
    rows = with_entities(docs, **options)
    grave = F.exists("found", lambda f: f["entity"].isin(*critical)) if suppress and list(critical) else F.lit(False)
    verdict = F.when(F.size("found") == 0, "accept").when(grave, "suppress").otherwise("redact")
    longest = F.transform(F.array_sort(F.array_distinct(F.transform("found", lambda f: F.struct((-F.length(f["span"])).alias("size"), f["span"].alias("span"))))), lambda s: s["span"])
    rows = rows.select("doc_id", "text", verdict.alias("verdict"), F.array_sort(F.array_distinct("found.entity")).alias("entities"), longest.alias("keys"))
    keys = F.when(F.col("verdict") == "redact", F.col("keys")).otherwise(F.array().cast("array<string>"))
    masked = F.when(F.col("verdict") != "suppress", F.aggregate("keys", F.col("text"), lambda t, k: F.replace(t, k, F.lit("[REDACTED]"))))
    return rows.withColumn("keys", keys).withColumn("text", masked).select("doc_id", "verdict", "entities", "keys", "text")
