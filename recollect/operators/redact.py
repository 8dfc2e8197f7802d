"""Redaction of credentials in memories, turns and typed events: each secret gives way to [REDACTED:type:hash8]."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as in JavaScript; word borders are those of ASCII.
SPACE = r"\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Detectors in order (type, pattern, flags, group).
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
DETECTORS = (
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", 0, 0),
    ("github_token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,255}\b|\bgithub_pat_[A-Za-z0-9_]{20,255}\b", 0, 0),
    ("azure_key", r"\bAccountKey\s*=\s*(\S+)", re.I, 1),
    ("azure_key", r"[?&]sig=([A-Za-z0-9%+/=]{10,})", re.I, 1),
    ("azure_key", r"\b[A-Za-z0-9+/]{86}==", 0, 0),
    ("gcp_api_key", r"\bAIza[0-9A-Za-z\-_]{35}\b", 0, 0),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,72}\b", 0, 0),
    ("generic_credential", r"\b(?:api[_-]?key|secret|token|password|passwd|pwd)\s*[:=]\s*(\S+)", re.I, 1),
    ("jwt", r"\bey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0, 0),
    ("connection_string", r"\b[a-zA-Z][a-zA-Z0-9+.-]*://([^/\s:@]+:[^/\s@]+)@", 0, 1),
)


def _compiled(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern whose white space is that of JavaScript, inside and outside of sets, and whose borders and cases are those of ASCII."""
    inside = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
    return re.compile(inside.replace(r"\s*", f"[{SPACE}]*").replace(r"\S+", f"[^{SPACE}]+"), flags | re.ASCII)


COMPILED = [(kind, _compiled(pattern, flags), group) for kind, pattern, flags, group in DETECTORS]
TOKEN = re.compile(f"[^{SPACE}]+")
#: What a token of high entropy may be without being a secret.
PLACEHOLDER = re.compile(r"\[REDACTED:[^\]]+\]")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]{40}|[0-9a-fA-F]{64}")
NEAR_DIGEST = re.compile(r"\b(?:commit|sha|hash|digest)\b", re.I | re.ASCII)
LEAST_TOKEN, NEAR = 20, 40

Finding = tuple[str, str, int]


def _units(text: str) -> int:
    """The length as JavaScript counts it, in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _entropy(token: str) -> float:
    size = _units(token)
    return -sum(n / size * math.log2(n / size) for n in Counter(token).values())


def _replaced(text: str, spans: list[tuple[int, int, str]], found: list[Finding]) -> str:
    """Spans by start; one that starts within the last kept one, or within a placeholder, stays out. A finding's offset is that in the text it was found in."""
    held = [m.span() for m in PLACEHOLDER.finditer(text)] if spans else []
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: s[0]):
        if start < at or end <= start or any(a < end and start < b for a, b in held):
            continue
        digest = hashlib.sha256(text[start:end].encode("utf-8", "replace")).hexdigest()[:8]
        out += [text[at:start], f"[REDACTED:{kind}:{digest}]"]
        found.append((kind, digest, _units(text[:start])))
        at = end
    return "".join([*out, text[at:]])


def _window(text: str, start: int, end: int) -> str:
    return text[max(0, start - NEAR) : end + NEAR]


def _guarded(token: str, text: str, start: int, end: int) -> bool:
    """Placeholders, UUIDs and paths, each as a whole token, and digests that are called so nearby."""
    if PLACEHOLDER.fullmatch(token) or UUID.fullmatch(token) or "/" in token or "\\" in token:
        return True
    return bool(DIGEST.fullmatch(token) and NEAR_DIGEST.search(_window(text, start, end)))


def redactions(text: str, threshold: float = 4.0, custom: tuple[str, ...] = ()) -> tuple[str, list[Finding]]:
    """The text without secrets, and what was found (type, hash8, offset): key blocks first, then patterns, then tokens of high entropy."""
    found: list[Finding] = []
    text = _replaced(text, [(*m.span(), "pem_private_key") for m in re.finditer(PEM, text)], found)
    spans = [(*m.span(group), kind) for kind, pattern, group in COMPILED for m in pattern.finditer(text)]
    for source in custom:
        try:
            spans += [(*m.span(), "custom") for m in _compiled(source).finditer(text)]
        except re.error:
            continue
    text = _replaced(text, spans, found)
    tokens = [(*m.span(), "high_entropy") for m in TOKEN.finditer(text) if _units(m[0]) >= LEAST_TOKEN and not _guarded(m[0], text, *m.span()) and _entropy(m[0]) >= threshold]
    return _replaced(text, tokens, found), found


def redact_text(text: str, threshold: float = 4.0, custom: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """The text without secrets, and the types found."""
    text, found = redactions(text, threshold, custom)
    return text, [kind for kind, _, _ in found]


RESULT = "text string, types array<string>, events array<struct<type:string,hash8:string,offset:int>>"


def _row(text: str | None, threshold: float, custom: tuple[str, ...]) -> tuple:
    if text is None:
        return None, [], []
    out, found = redactions(text, threshold, custom)
    return out, [kind for kind, _, _ in found], found


def _plain(text: Column) -> Column:
    empty = F.array()
    return F.struct(text.alias("text"), empty.cast("array<string>").alias("types"), empty.cast("array<struct<type:string,hash8:string,offset:int>>").alias("events"))


#: What every text with a finding of redactions() has, but for custom patterns; a token may be shorter in characters where some lie beyond 16 bits.
HINT = r"(?i)\S{20}|[\x{10000}-\x{10FFFF}]|api[_-]?key|secret|token|password|passwd|pwd|AccountKey|sig=|xox|://|-----BEGIN"


def redacted(text: Column, threshold: float = 4.0, custom: tuple[str, ...] = (), enabled: bool = True) -> Column:
    """struct(text, types, events) of a text column; only texts that may hold a finding go through Python, in Arrow batches."""
    if not enabled:
        return _plain(text)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(t, threshold, custom) for t in texts], columns=["text", "types", "events"])

    may = F.lit(True) if custom else F.coalesce(text.rlike(HINT), F.lit(False))
    return F.when(may, run(F.when(may, text))).otherwise(_plain(text))


def redacted_rows(rows: DataFrame, text: str = "text", threshold: float = 4.0, custom: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """Adds r, struct(text, types, events)."""
    return rows.withColumn("r", redacted(F.col(text), threshold, custom, enabled))


def redacted_lists(rows: DataFrame, items: str, field: str, threshold: float = 4.0, custom: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """The array of structs `items` (turns, or typed events) with `field` of each redacted, and findings, an array of (at, type, hash8, offset)."""
    none = F.array().cast("array<struct<at:int,type:string,hash8:string,offset:int>>")
    if not enabled:
        return rows.withColumn("findings", none)

    @F.pandas_udf(f"array<struct<{RESULT.replace(' string', ':string').replace(' array', ':array')}>>")
    def run(lists: pd.Series) -> pd.Series:
        keys = ("text", "types", "events")
        return lists.map(lambda texts: None if texts is None else [dict(zip(keys, _row(t, threshold, custom), strict=True)) for t in texts])

    texts = F.transform(items, lambda x: x[field])
    may = F.lit(True) if custom else F.coalesce(F.exists(texts, lambda x: x.rlike(HINT)), F.lit(False))
    out = rows.withColumn("r", run(F.when(may, texts)))
    told = F.flatten(F.transform("r", lambda x, at: F.transform(x["events"], lambda e: F.struct(at.alias("at"), e["type"].alias("type"), e["hash8"].alias("hash8"), e["offset"].alias("offset")))))
    changed = F.zip_with(items, "r", lambda x, r: F.when(x.isNotNull(), x.withField(field, r["text"])))
    return out.withColumns({items: F.when(F.col("r").isNotNull(), changed).otherwise(F.col(items)), "findings": F.coalesce(told, none)}).drop("r")


def counts(rows: DataFrame, types: str = "types") -> DataFrame:
    return rows.select(F.explode(types).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
