"""Splits long texts into overlapping chunks at the coarsest separator that keeps them short."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Separators from coarse to fine; the empty one splits into characters.
PLAIN = ("\n\n", "\n", " ", "")
STATUTE = ("\n第", "\n\n", "\n", "。", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """The text before each separator; a separator begins the piece after it."""
    if not separator:
        return list(text)
    return [p for p in re.split(f"(?={re.escape(separator)})", text) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces of at most `size` characters; each begins with the last ones of the run before, up to `overlap`."""
    run, length = deque(), 0
    for piece in pieces:
        if run and length + len(piece) > size:
            yield "".join(run)
            while run and (length > overlap or length + len(piece) > size):
                length -= len(run.popleft())
        run.append(piece)
        length += len(piece)
    if run:
        yield "".join(run)


def chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = PLAIN) -> list[str]:
    """Chunks of a text, trimmed, none blank. A piece that is too long is split again at the finer separators."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer, short, out = separators[at + 1 :], [], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size or not separators[at]:
            short.append(piece)
            continue
        out += _packed(short, size, overlap)
        short = []
        out += chunks(piece, size, overlap, finer) if finer else [piece]
    out += _packed(short, size, overlap)
    return [c for c in map(str.strip, out) if c]


def chunked(text: Column, size: int = 800, overlap: int = 100, separators: tuple[str, ...] = PLAIN) -> Column:
    """array<string> of the chunks of a text; null and blank texts have none. Texts come a hundred at a time, not by Arrow batches of
    10000, so that a worker holds few of them."""

    @F.udf(ArrayType(StringType()), useArrow=False)
    def run(text: str | None) -> list[str]:
        return chunks(text, size, overlap, separators) if text else []

    return run(text)
