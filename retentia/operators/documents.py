"""Chunks and fingerprints of documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a text is cut, first choice first.
LEVELS = ("\n## ", "\n### ", "\n\n")
TOKEN = re.compile(r"\w+|[^\w\s]", re.ASCII)


def count_tokens(text: str) -> int:
    """Words and signs, as the JVM side estimates them; any exact tokenizer can take its place."""
    return len(TOKEN.findall(text))


def _sections(text: str, start: int, end: int, mark: str) -> Iterator[tuple[int, int]]:
    """Offsets of the stretches that begin at `start` and at every mark behind it."""
    look = start
    while start < end:
        stop = text.find(mark, look, end)
        stop = end if stop < 0 else stop
        if stop > start:
            yield start, stop
        start, look = stop, stop + len(mark)


def _cuts(text: str, start: int, end: int, limit: int, count: Callable[[str], int], levels: tuple[str, ...], step: int) -> Iterator[tuple[int, int]]:
    """Offsets of the parts of a stretch that is too long. Every section is counted once; a pack is the sum of its sections."""
    if not levels:
        yield from ((a, min(a + step, end)) for a in range(start, end, step))
        return
    held = 0
    for a, b in _sections(text, start, end, levels[0]):
        n = count(text[a:b])
        if held + n > limit and start < a:
            yield start, a
            start, held = a, 0
        if n > limit:
            yield from _cuts(text, a, b, limit, count, levels[1:], step)
            start = b
        else:
            held += n
    if start < end:
        yield start, end


def split_text(text: str, limit: int, count: Callable[[str], int] = count_tokens, chars_per_token: int = 3) -> list[str]:
    """Parts of at most `limit` tokens: packed sections, of a longer section its subsections, then paragraphs, at last a cut by characters."""
    if count(text) <= limit:
        return [text]
    return [text[a:b] for a, b in _cuts(text, 0, len(text), limit, count, LEVELS, limit * chars_per_token)]


def chunk(documents: DataFrame, limit: int = 25_000, count: Callable[[str], int] = count_tokens, chars_per_token: int = 3) -> DataFrame:
    """(doc_id, chunk_index, section, token_count, text): one chunk `Full Paper`, or parts when the text is too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                parts = split_text(t, limit, count, chars_per_token)
                rows += [(d, i, "Full Paper" if len(parts) == 1 else f"Part {i + 1}", count(p), p) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section", "token_count", "text"])

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk_index int, section string, token_count int, text string")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, sha256, char_len): null text gives nulls."""
    return documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("char_len"))


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(first_id, n): documents per distinct text."""
    return documents.where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")
