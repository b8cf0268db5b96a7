"""Line deduplication by winnowing over line hashes.

Documents are sequences of lines; lines of white space only do not count. A run is `least`
lines in a row, or one line of `words` words by itself: shorter lines are too often equal
by chance.

The hashes of GRAM lines in a row (one, if runs of one line count) are winnowed: of each
window of least - GRAM + 1 of them the smallest is the fingerprint, so that every run of
`least` lines has a fingerprint, wherever it stands; a long line is a window and a
fingerprint of its own. Positions that share a fingerprint are joined, and the match is
extended line by line to both sides: the runs of `least` lines around a shared position are
looked up among those of all positions with this fingerprint. Runs that occur earlier are
deleted. Every count is combined in the tasks before rows meet, and the joins have one row
per fingerprint or run on one side, so that a line in a third of all documents can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import BLOCK, SPACE, durable, map_rows, mix, sorted_join, span_hashes
from ragassay.llm.repeats import anchors
from ragassay.llm.suffix import _versioned, replace_texts

GRAM = 2
ALONE = np.uint64(0xA10E)
#: lines of a run, words of a line that is a run by itself
LEAST, WORDS = 3, 5


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (in the text split at line feeds), hashes and words of the lines that count."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    blank = np.concatenate(([True], SPACE[data]))
    begun = np.concatenate(([0], np.cumsum(blank[:-1] & ~blank[1:])))
    words = begun[ends] - begun[starts]  # a line feed is white space: no word spans two lines
    number = np.flatnonzero(words)
    starts, ends = starts[number], ends[number]
    hashes = np.empty(len(number), np.uint64)
    first = 0
    while first < len(number):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        low, high = starts[first], ends[last - 1]
        hashes[first:last] = span_hashes(
            data[low:high].astype(np.uint64) + np.uint64(1),
            starts[first:last] - low,
            ends[first:last] - low,
        )
        first = last
    return number, hashes, words[number]


def fingerprints(docs: DataFrame, least: int, words: int | None) -> DataFrame:
    """fingerprint, doc_id, version, low, lines, runs: winnowed positions and the hashes of
    the runs of `least` lines that contain them and have no other fingerprint; then the
    lines of `words` words, as runs of one line."""

    def of_row(doc_id: int | None, version: int, text: str) -> Iterator[tuple]:
        _, hashes, size = line_hashes(text)
        keys, _, lows, highs = anchors(hashes, least, min(GRAM, least))
        for key, low, high in zip(
            keys.view(np.int64).tolist(), lows.tolist(), highs.tolist(), strict=True
        ):
            at = np.arange(low, high + 1)
            runs = span_hashes(hashes, at, at + least).view(np.int64).tolist()
            yield key, doc_id, version, low, least, runs
        if words is not None and least > 1:
            alone = np.flatnonzero(size >= words)
            keys = mix(hashes[alone] ^ ALONE).view(np.int64).tolist()
            for key, low, line in zip(keys, alone.tolist(), hashes[alone].view(np.int64).tolist(), strict=True):
                yield key, doc_id, version, low, 1, [line]

    schema = "fingerprint bigint, doc_id bigint, version bigint, low int, lines int, runs array<bigint>"
    return map_rows(_versioned(docs), schema, of_row)


def repeated_runs(docs: DataFrame, least: int = LEAST, words: int | None = WORDS) -> DataFrame:
    """doc_id, version, spans (start, lines): the runs that occur earlier.

    Line numbers count the lines with ink from 0. Earlier means a smaller doc_id (null
    first), then text hash, then position. Rows that repeat doc_id and text count once.
    """
    found = durable(fingerprints(docs, least, words).distinct())
    shared = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = sorted_join(found, durable(shared), "fingerprint").select(
        "fingerprint", "doc_id", "version", "low", "lines", F.posexplode("runs").alias("i", "run")
    )
    runs = durable(
        joined.select(
            "fingerprint", "run", "doc_id", "version", (F.col("low") + F.col("i")).alias("start"), "lines"
        )
    )
    firsts = runs.groupBy("fingerprint", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "version", "start")).alias("first")
    )
    later = sorted_join(runs, durable(firsts.filter("n > 1")), ["fingerprint", "run"]).filter(
        F.struct("doc_id", "version", "start") > F.col("first")
    )
    return later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "lines"))).alias("spans"))


def drop_lines(docs: DataFrame, least: int = LEAST, words: int | None = WORDS) -> DataFrame:
    """docs without lines that lie in a run of `least` or more lines occurring earlier, or
    that have `words` or more words (None: no such rule) and occur earlier.

    Columns are unchanged, an n_chars column is counted anew, every document stays, also
    one of which nothing is left. Null, empty and shorter texts are unchanged; lines of
    white space stay where they are. Rows that repeat doc_id and text are cut alike. An
    empty table gives an empty result.
    """

    return replace_texts(docs, repeated_runs(docs, least, words), _without)


def _without(text: str, spans: list) -> str:
    number, _, _ = line_hashes(text)
    gone = {int(number[s["start"] + i]) for s in spans for i in range(s["lines"])}
    return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])
