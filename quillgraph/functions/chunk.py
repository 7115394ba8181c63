"""Heading-aware chunks of documents with byte spans.

A heading (`#` or `=` once to six times, a space, text) outside fences opens a section.  A section's lines
fill chunks of up to so many characters; a longer line is cut.  Each chunk has its title, or title and
section, and the bytes of its lines in the text.  Blank chunks are left out; null and empty texts have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"^(?:(#{1,6})|(={1,6})) (.*)$")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def heading(line: str) -> str | None:
    m = _HEADING.match(line.rstrip())
    if not m:
        return None
    return m[3].strip().rstrip("#" if m[1] else "=").strip() or None


def sections(text: str) -> Iterator[tuple[str | None, list[tuple[int, str]]]]:
    """(heading, [(character offset, line)]) in order; the first section has no heading."""
    name, held, fenced = None, [], False
    for m in _LINE.finditer(text):
        line = m[0]
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (found := heading(line)):
            yield name, held
            name, held = found, []
        held.append((m.start(), line))
    yield name, held


def spans(lines: list[tuple[int, str]], most: int) -> Iterator[tuple[int, int]]:
    """Character spans of a section's chunks."""
    start = end = None
    for at, line in lines:
        stop = at + len(line)
        if len(line) > most:
            if start is not None:
                yield start, end
            for cut in range(at, stop, most):
                start, end = cut, min(cut + most, stop)
                if end < stop:
                    yield start, end
            continue
        if start is not None and stop - start > most and not _blank(lines, start, end):
            yield start, end
            start = None
        start, end = at if start is None else start, stop
    if start is not None:
        yield start, end


def _blank(lines: list[tuple[int, str]], start: int, end: int) -> bool:
    return not any(line.strip() for at, line in lines if at < end and at + len(line) > start)


def chunk_text(title: str, text: str, most: int, offset: int = 0) -> list[tuple[str, str, int, int]]:
    """(breadcrumb, chunk, byte start, byte end); offset: where text begins in its file."""
    out, chars, size = [], 0, offset
    for name, lines in sections(text):
        crumb = title if name is None or name == title else f"{title} › {name}"
        for a, z in spans(lines, most):
            size += len(text[chars:a].encode())
            begin = size
            size += len(text[a:z].encode())
            chars = z
            if text[a:z].strip():
                out.append((crumb, text[a:z].strip("\r\n"), begin, size))
    return out


def chunks(docs: DataFrame, key: str, most: int) -> DataFrame:
    """(key, chunk int, breadcrumb, text, byte_start, byte_end) of rows (key, title, text)."""

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for k, title, text in zip(b[key].to_pylist(), b["title"].to_pylist(), b["text"].to_pylist(), strict=True):
                found = chunk_text(title or "", text or "", most)
                keys += [k] * len(found)
                rows += [(i, *c) for i, c in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(keys, b[key].type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "chunk", "breadcrumb", "text", "byte_start", "byte_end"])

    return docs.select(key, "title", "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, chunk int, breadcrumb string, text string, byte_start long, byte_end long")
