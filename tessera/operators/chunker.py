"""Heading-aware chunking: blocks, word windows of long blocks, and merging of neighbours under one heading.

One generator per document, run in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
SCHEMA = ("doc_id {kind}, chunk_index int, total_chunks int, heading_path array<string>, section_title string, text string, token_count int, "
          "content_hash string, normalized_text_hash string")


def blocks(text: str, title: str | None) -> Iterator[tuple[tuple, str | None, str]]:
    """(heading path, section title, text) of each run of lines without a heading or blank line."""
    path: list[str | None] = []
    section, lines, any_block = None, [], False
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        m = HEADING.match(line)
        if (m or not line.strip()) and lines:
            any_block = True
            yield tuple(path), section or title, "\n".join(lines).strip()
            lines = []
        if m:
            level = len(m[1])
            path = (path + [None] * level)[:level - 1] + [m[2]]
            section = m[2]
        elif line.strip():
            lines.append(line)
    if not any_block and text.strip():
        yield (), title, text.strip()


def windows(text: str, longest: int, overlap: int) -> Iterator[str]:
    words = text.split()
    if len(words) <= longest:
        yield text
        return
    step = max(1, longest - overlap)
    for i in range(0, len(words), step):
        yield " ".join(words[i:i + longest])
        if i + longest >= len(words):
            return


def chunks(text: str, longest: int, overlap: int, title: str | None = None) -> list[tuple[tuple, str | None, str]]:
    out: list[tuple[tuple, str | None, str]] = []
    for path, section, block in blocks(text.strip(), title):
        whole = [block] if len(block.split()) <= longest else re.split(r"\n{2,}", block)
        for piece in (w for b in whole if b.strip() for w in windows(b.strip(), longest, overlap)):
            if out and out[-1][0] == path and len(out[-1][2].split()) + len(piece.split()) <= longest:
                out[-1] = (path, out[-1][1], f"{out[-1][2]}\n\n{piece}")
            else:
                out.append((path, section, piece))
    return out


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, *, longest: int = 320, overlap: int = 40) -> DataFrame:
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), title.alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for pdf in batches:
            rows = []
            for doc, text, name in pdf.itertuples(index=False):
                got = chunks(text or "", longest, overlap, name)
                rows += [(doc, i, len(got), list(p), s, t, len(t.split()), sha(t), sha(" ".join(t.split()).lower())) for i, (p, s, t) in enumerate(got)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "total_chunks", "heading_path", "section_title", "text", "token_count", "content_hash", "normalized_text_hash"])

    return slim.mapInPandas(run, SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString()))
