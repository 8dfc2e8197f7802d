"""Chunks of transcripts: turns packed up to a size, oversized ones by paragraph and line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TURN = re.compile(r"^(user|assistant|system|human|ai)\s*:", re.I)


def turns(text: str) -> list[str]:
    out: list[list[str]] = []
    for line in text.split("\n"):
        if not out or TURN.match(line):
            out.append([])
        out[-1].append(line)
    return [t for t in ("\n".join(x).strip() for x in out) if t]


def _packed(parts: list[str], joiner: str, most: int) -> Iterator[str]:
    held = ""
    for part in parts:
        joined = f"{held}{joiner}{part}" if held else part
        if held and len(joined) > most:
            yield held
            held = part
        else:
            held = joined
    if held:
        yield held


def chunk_text(text: str, most: int = 3200) -> list[str]:
    """Chunks of at most `most` characters, but for single lines that are longer; an empty text is one empty chunk."""
    parts: list[str] = []
    for turn in turns(text):
        if len(turn) <= most:
            parts.append(turn)
            continue
        for paragraph in re.split(r"\n{2,}", turn):
            parts += [paragraph] if len(paragraph) <= most else list(_packed(paragraph.split("\n"), "\n", most))
    return list(_packed(parts, "\n\n", most)) or [""]


def chunk(docs: DataFrame, key: str, text: str, most: int = 3200) -> DataFrame:
    """(key, index, text) of every chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text], strict=True) for i, c in enumerate(chunk_text(t or "", most))]
            yield pd.DataFrame(rows, columns=[key, "index", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, index int, text string")
