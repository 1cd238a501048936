"""Splitting of documents into overlapping chunks of a token budget."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.runtime import extended, ship

_COUNTED = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]|[A-Za-z0-9_]+")
#: Where a text that is too long is taken apart: before headings, at empty lines, behind sentences.
_SEPARATORS = (re.compile(r"(?m)(?=^#{1,6}\s)"), re.compile(r"\n\s*\n"), re.compile(r"(?<=[。！？!?；;.])"))


def _pieces(text: str, marks: list[int], low: int, high: int, budget: int, overlap: int, level: int = 0) -> Iterator[tuple[str, int]]:
    """Parts within the budget and their tokens; ``marks`` are the places where tokens of the text begin.

    What no separator makes small enough is cut before every so many tokens, so that each
    window has the budget exactly and begins with the last ones of the window before it.
    """
    first, last = bisect_left(marks, low), bisect_left(marks, high)
    if last - first <= budget:
        if part := text[low:high].strip():
            yield part, last - first
    elif level < len(_SEPARATORS):
        for gap in _SEPARATORS[level].finditer(text, low, high):
            if gap.start() > low:
                yield from _pieces(text, marks, low, gap.start(), budget, overlap, level + 1)
            low = gap.end()
        yield from _pieces(text, marks, low, high, budget, overlap, level + 1)
    else:
        step = max(1, budget - overlap)
        for i in range(first, max(first + 1, last - overlap), step):
            end = marks[i + budget] if i + budget < last else high
            yield text[low if i == first else marks[i] : end].strip(), min(budget, last - i)


def chunks(text: str | None, budget: int = 512, overlap: int = 64) -> list[tuple[str, int]]:
    """Chunks and their tokens: parts are packed in order; a chunk begins with the last parts of the one before, up to ``overlap`` tokens."""
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    text = text or ""
    for part, n in _pieces(text, [m.start() for m in _COUNTED.finditer(text)], 0, len(text), budget, overlap):
        if held and sum(k for _, k in held) + n > budget:
            out.append(_whole(held))
            room = min(overlap, budget - n)
            while held and sum(k for _, k in held) > room:
                held.pop(0)
        held.append((part, n))
    return [*out, _whole(held)] if held else out


def _whole(parts: list[tuple[str, int]]) -> tuple[str, int]:
    return "\n\n".join(p for p, _ in parts), sum(n for _, n in parts)


def chunked(docs: DataFrame, text: str = "text", budget: int = 512, overlap: int = 64) -> DataFrame:
    """A row for each chunk in place of the text: other columns, ``chunk``, ``chunk_index`` and ``token_count``."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                rows = [(i, c, k, n) for i, t in enumerate(batch.column(text).to_pylist()) for k, (c, n) in enumerate(chunks(t, budget, overlap))]
                at = pa.array([r[0] for r in rows], pa.int32())
                made = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *made], [*keep, "chunk", "chunk_index", "token_count"])

    return docs.mapInArrow(run, extended(docs.select(*keep).schema, "chunk string, chunk_index int, token_count int"))
