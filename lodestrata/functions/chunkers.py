"""Chunkers whose next cut depends on the one before; they run on Arrow batches inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What trimming takes away.
BLANK = " \t\n\r\x00\x0b"
#: Sentence ends in the order in which they are tried. Those with a break are a backslash and an n in the
#: text, not a line feed, which comes last of all.
SENTENCE_ENDS = (". ", ".\\n", "! ", "!\\n", "? ", "?\\n")


def chunk_end(window: str) -> int:
    """Where a window of text is cut: behind the last paragraph break in its last 40 per cent, else the last sentence
    end of the first kind found there, else the last line break; else at its end."""
    least = int(len(window) * 0.6)
    for mark in ("\n\n", *SENTENCE_ENDS, "\n"):
        at = window.rfind(mark)
        if at >= max(0, least):
            return at + len(mark)
    return len(window)


def sentence_chunks(text: str, size: int = 1500, overlap: int = 300, least: int = 20) -> list[str]:
    """Chunks of ``size`` characters at most, cut at sentence ends; the next one begins ``overlap`` characters before
    the trimmed length of this one, 100 further at least. Those of ``least`` characters or fewer go."""
    out, at = [], 0
    while at < len(text):
        window = text[at : at + size]
        piece = (window[: chunk_end(window)] if at + size < len(text) else window).strip(BLANK)
        if len(piece) > least:
            out.append(piece)
        at += max(100, len(piece) - overlap)
    return out


def packed_paragraphs(text: str, size: int = 800, carry: int = 80, whole: int = 100) -> list[str]:
    """Paragraphs, which blank lines part, packed into chunks of about ``size`` characters; each chunk but the first
    begins with the last ``carry`` characters of the one before. A text of fewer than ``whole`` characters is one chunk
    as it is."""
    if len(text) < whole:
        return [text]
    out, buffer = [], ""
    for paragraph in (p.strip(BLANK) for p in re.split("\n{2,}", text)):
        if not paragraph:
            continue
        if buffer and len(buffer) + len(paragraph) > size:
            out.append(buffer)
            buffer = f"{buffer[-carry:]}\n{paragraph}"
        else:
            buffer = f"{buffer}\n\n{paragraph}" if buffer else paragraph
    return [*out, buffer] if buffer else out


def buffered_paragraphs(text: str, size: int = 2000, least: int = 20, rest: int = 50) -> list[str]:
    """Lines of ``least`` characters or more, joined by blanks until there are ``size`` characters; what is left at the
    end counts from ``rest`` characters on."""
    out, buffer = [], ""
    for line in (" ".join(x.split()) for x in text.split("\n")):
        if len(line) >= least:
            buffer += " " + line
            if len(buffer) >= size:
                out.append(buffer.strip())
                buffer = ""
    return [*out, buffer.strip()] if len(buffer.strip()) > rest else out


def chunk_with(docs: DataFrame, chunker: Callable[[str], list[str]], id_col: str, text_col: str) -> DataFrame:
    """(id, chunk_index, content) by a chunker of one text; null texts have no chunks."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            rows = [(i, k, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, c in enumerate(chunker(t or ""))]
            columns = [list(x) for x in zip(*rows, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], [id_col, "chunk_index", "content"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, chunk_index int, content string")
