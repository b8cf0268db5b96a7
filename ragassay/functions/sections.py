"""Sections of a text by its headings, and sentence windows by the distance of neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from ragassay.functions.embedding import Embedder

#: a heading is a line of one to six # and a title, or of a decimal number and a title
_HASHED = re.compile(r"(#{1,6})[ \t]+(\S.*)")
_NUMBERED = re.compile(r"([0-9]{1,3}(?:\.[0-9]{1,3}){0,5})\.?[ \t]+(\S.*)")
#: longest title of a numbered heading: longer lines are sentences that begin with a number
TITLE = 80
#: a sentence ends at these, before white space, or with its line
_SENTENCE = re.compile(r"[^\n]*?[.!?…]+(?=\s)|[^\n]+")


def heading(line: str) -> tuple[int, str] | None:
    """Level (from 1) and title of a heading line."""
    line = line.strip(" \t\r")
    if found := _HASHED.fullmatch(line):
        title = found[2].rstrip("# \t")
        return (len(found[1]), title) if title else None
    found = _NUMBERED.fullmatch(line)
    if found and len(found[2]) <= TITLE and found[2][-1] not in ".!?;,:":
        return found[1].count(".") + 1, found[2]
    return None


def sections(text: str) -> Iterator[tuple[list[str], str]]:
    """Headings above (outermost first) and body of each section with ink in its body.

    A heading closes all headings of its level and deeper ones; a level that was skipped has
    no title. Headings without a body stand in the paths of what follows only.
    """
    stack: list[tuple[int, str]] = []
    body: list[str] = []
    for line in text.split("\n"):
        found = heading(line)
        if found is None:
            body.append(line)
            continue
        yield from _section(stack, body)
        body = []
        while stack and stack[-1][0] >= found[0]:
            stack.pop()
        stack.append(found)
    yield from _section(stack, body)


def _section(stack: list[tuple[int, str]], body: list[str]) -> Iterator[tuple[list[str], str]]:
    text = "\n".join(body)
    if text.strip():
        yield [title for _, title in stack], text


def sentences(text: str) -> list[str]:
    """Sentences in order, without the white space around them."""
    return [s for s in (m.strip() for m in _SENTENCE.findall(text)) if s]


def breaks(vectors: np.ndarray, percentile: float) -> np.ndarray:
    """Places k where sentence k is farther from the one before than that percentile of all
    such distances of the text."""
    unit = np.asarray(vectors, float)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(norms == 0, 1.0, norms)
    distances = np.round(1.0 - np.einsum("ij,ij->i", unit[1:], unit[:-1]), 9)
    if not len(distances):
        return np.empty(0, np.int64)
    return np.flatnonzero(distances > np.quantile(distances, percentile, method="lower")) + 1


def windows(text: str, embed: Embedder, percentile: float, longest: int) -> list[str]:
    """Sentences of a text joined up to each break, and cut before they exceed longest
    characters; a longer sentence stays whole."""
    found = sentences(text)
    if not found:
        return []
    cuts = set(breaks(embed(found, "document"), percentile).tolist())
    out, held, size = [], [], 0
    for k, sentence in enumerate(found):
        if held and (k in cuts or size + 1 + len(sentence) > longest):
            out.append(" ".join(held))
            held, size = [], 0
        size += len(sentence) + (1 if held else 0)
        held.append(sentence)
    return [*out, " ".join(held)]
