"""Repeated runs in sequences of tokens: content-selected anchors and spans.

A window is `least` tokens in a row. The window's anchor is the position of the smallest
hash among its `gram`-token grams (the leftmost of equals). Each window has exactly one
anchor, equal windows have it in the same place, and an anchor answers for consecutive
windows: it is the only position that has to be compared for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from ragassay.llm.common import gram_hashes, mix, span_hashes, window_minima


def anchors(hashes: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """keys, contexts, lows, highs: for each anchor the hash of its gram, the hash of all
    tokens of the windows it answers for, and the first and last of these windows."""
    grams = gram_hashes(hashes, gram)
    chosen = window_minima(grams, least - gram + 1)
    if not len(chosen):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    lows = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
    highs = np.append(lows[1:] - 1, len(chosen) - 1)
    at = chosen[lows]
    contexts = span_hashes(hashes, lows, highs + least) ^ mix((at - lows).astype(np.uint64))
    return grams[at], contexts, lows, highs


def merged(spans: Iterable[tuple]) -> list[list]:
    """Unite spans (start, end, source) that overlap or touch; sources become a set."""
    out: list[list] = []
    for start, end, source in sorted(spans, key=lambda s: s[:2]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].add(source)
        else:
            out.append([start, end, {source}])
    return out
