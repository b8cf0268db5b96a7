"""Repeated passages by a sparse suffix array.

1. Of each text only the suffixes that start at content-selected positions are kept:
   the minimiser anchors of `repeats`, about one word in twenty. A passage of `least`
   words contains such a position, wherever it stands.
2. The suffixes are sorted over the whole corpus (range partitioning, with document and
   position as the last keys, so that a passage that a third of all documents share is
   dealt over many tasks) and compared with their neighbours. Neighbours that agree in
   all words around the anchor repeat whole: all but the first go. Neighbours that agree
   in the anchor's words only are extended. A task does not see its neighbours in other
   tasks, therefore its first and last run of suffixes are extended in any case.
3. Extension to the left and right: each window of `least` words around an extended
   anchor is looked up by its hash (with the anchor's, 128 bits) among the windows of
   all extended anchors. So a match is followed word by word to both sides, to the
   longest, even when the partner is not the neighbour with the longest common prefix.

The result is exact: a word is repeated if it lies in a window of `least` words that
occurs earlier in the corpus, in order of doc_id and position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import durable, map_rows, sorted_join, span_hashes, texts_of, words
from ragassay.llm.repeats import anchors, merged

GRAM = 10
_SUFFIX = "key bigint, context bigint, doc_id bigint, version bigint, low int, high int"
_FOUND = "doc_id bigint, version bigint, low int, high int, source bigint, whole boolean"


def _versioned(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), text: a row's identity, also for repeated ids."""
    return texts_of(docs).select("doc_id", F.xxhash64("text").alias("version"), "text")


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """The retained suffixes: anchor hash, hash of all words around, document, windows."""

    def of_row(doc_id: int | None, version: int, text: str) -> Iterator[tuple]:
        _, _, hashes = words(text)
        keys, contexts, lows, highs = anchors(hashes, least, GRAM)
        for key, context, low, high in zip(
            keys.view(np.int64).tolist(),
            contexts.view(np.int64).tolist(),
            lows.tolist(),
            highs.tolist(),
            strict=True,
        ):
            yield key, context, doc_id, version, low, high

    return map_rows(_versioned(docs), _SUFFIX, of_row)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare sorted suffixes with their neighbours.

    Of a run of equal contexts the first stays; it is handed on for extension (whole =
    false) if a neighbouring run has the same anchor, or at the edges of the partition.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("version", pa.int64()),
            ("low", pa.int32()),
            ("high", pa.int32()),
            ("source", pa.int64()),
            ("whole", pa.bool_()),
        ]
    )

    def out(batch: pa.RecordBatch | pa.Table, at: np.ndarray, source: pa.Array, whole: bool):
        part = batch.take(pa.array(at))
        columns = [part.column(n) for n in ("doc_id", "version", "low", "high")]
        return pa.RecordBatch.from_arrays(
            [*columns, source, pa.array(np.full(len(at), whole))], schema=schema
        )

    first, told = None, True  # the first suffix of the run that goes on, and if it went out
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        body = batch if first is None else pa.concat_batches([first, last, batch])
        begin = 0 if first is None else 2
        key, context, version, low = (
            body.column(n).to_numpy() for n in ("key", "context", "version", "low")
        )
        doc = body.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        new = np.ones(len(key), bool)  # starts a run
        new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        same = np.zeros(len(key), bool)  # a repeated row, not another place
        same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (version[1:] == version[:-1])
        same[1:] &= low[1:] == low[:-1]
        if begin:
            new[1], same[1] = False, False
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        later = np.flatnonzero(~new & ~same)
        later = later[later >= begin]
        if len(later):
            yield out(body, later, body.column("doc_id").take(pa.array(starts[run[later]])), True)
        meets = np.zeros(len(starts), bool)
        touch = key[starts[1:]] == key[starts[:-1]]
        meets[1:] |= touch
        meets[:-1] |= touch
        if begin:
            meets[0] &= not told
        else:
            meets[0] = True  # the partition's first run
        went = told if begin and len(starts) == 1 else False
        found = starts[meets]
        if len(found):
            yield out(body, found, pa.nulls(len(found), pa.int64()), False)
        told = went or bool(meets[-1])
        first = body.slice(int(starts[-1]), 1)
        last = body.slice(len(key) - 1, 1)
    if first is not None and not told:
        yield out(first, np.array([0]), pa.nulls(1, pa.int64()), False)


def _window_hashes(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """anchor, window (hashes), doc_id, version, start: all windows of the given anchors."""
    wanted = places.groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges")
    )
    wanted = wanted.select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "ranges"
    )
    rows = _versioned(docs)
    rows = sorted_join(
        rows,
        wanted,
        rows["doc_id"].eqNullSafe(wanted["__id"]) & (rows["version"] == wanted["__version"]),
    ).select("doc_id", "version", "text", "ranges")

    def of_row(doc_id: int | None, version: int, text: str, ranges: list) -> Iterator[tuple]:
        _, _, hashes = words(text)
        keys, _, lows, _ = anchors(hashes, least, GRAM)
        key_of = dict(zip(lows.tolist(), keys.view(np.int64).tolist(), strict=True))
        for place in ranges:
            at = np.arange(place["low"], place["high"] + 1)
            key = key_of[place["low"]]
            for start, window in zip(
                at.tolist(), span_hashes(hashes, at, at + least).view(np.int64).tolist(), strict=True
            ):
                yield key, window, doc_id, version, start

    schema = "anchor bigint, window bigint, doc_id bigint, version bigint, start int"
    return map_rows(rows, schema, of_row)


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """Spans of words that lie in a passage of `least` or more words occurring earlier.

    Words are runs without ASCII white space and are compared exactly, so white space
    does not matter. One row per longest span: doc_id, version (hash of the text),
    start_word, end_word (exclusive), source_doc_ids (documents with an equal passage,
    at least one of them earlier or the same document further ahead). The first
    occurrence is in no span. Earlier means a smaller doc_id (null first), then text
    hash, then position. Null, empty and shorter texts have no spans. Rows that repeat
    doc_id and text count once. An empty table gives an empty result; further columns
    are not read.
    """
    kept = durable(suffixes(docs, least))
    order = ["key", "context", "doc_id", "version", "low"]
    compared = durable(
        kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare, _FOUND)
    )
    windows = durable(_window_hashes(docs, compared.filter("not whole"), least))
    firsts = windows.groupBy("anchor", "window").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("doc_id", "version", "start")).alias("first"),
    )
    later = sorted_join(windows, durable(firsts.filter("n > 1")), ["anchor", "window"]).filter(
        F.struct("doc_id", "version", "start") > F.col("first")
    )
    spans = compared.filter("whole").select(
        "doc_id", "version", F.col("low").alias("start"), (F.col("high") + least).alias("end"), "source"
    ).union(
        later.select(
            "doc_id", "version", "start", (F.col("start") + least).alias("end"), F.col("first.doc_id")
        )
    )
    per_doc = spans.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("start", "end", "source")).alias("spans")
    )

    def of_row(doc_id: int | None, version: int, found: list) -> Iterator[tuple]:
        for start, end, sources in merged((s["start"], s["end"], s["source"]) for s in found):
            yield doc_id, version, start, end, sorted(sources - {None})

    schema = "doc_id bigint, version bigint, start_word int, end_word int, source_doc_ids array<bigint>"
    return map_rows(per_doc, schema, of_row)


def cut_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs with the spans of repeated_passages cut out of the text, columns unchanged.

    What is between two words goes with the first of them. An n_chars column is counted
    anew. Every document stays, also one of which nothing is left. Rows that repeat
    doc_id and text are cut alike.
    """
    spans = repeated_passages(docs, least).groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("spans")
    )
    return replace_texts(docs, spans, _without)


def _without(text: str, spans: list) -> str:
    starts, _, _ = words(text)
    data = text.encode()
    bounds = [*starts.tolist(), len(data)]
    out, at = [], 0
    for span in sorted(spans, key=lambda s: s["start_word"]):
        out.append(data[at : bounds[span["start_word"]]])
        at = bounds[span["end_word"]]
    return b"".join([*out, data[at:]]).decode()


def replace_texts(
    docs: DataFrame, marks: DataFrame, change: Callable[[str, list], str]
) -> DataFrame:
    """Put change(text, spans) for the text of each row of docs that has marks (doc_id,
    version, spans)."""
    marks = marks.select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("spans").alias("__spans")
    )
    # the columns of docs stay together, whatever their names
    rows = docs.select(
        F.struct(*docs.columns).alias("__row"),
        F.col("doc_id").alias("__of"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__hash"),
    )
    joined = sorted_join(
        rows,
        marks,
        rows["__of"].eqNullSafe(marks["__id"]) & (rows["__hash"] == marks["__version"]),
        "left",
    )
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("__row").flatten(), strict=True))
            texts = columns["text"].to_pylist()
            spans = batch.column("__spans").to_pylist()
            new = [change(t or "", s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                old = columns["n_chars"]
                counted = [
                    len(t or "") if s else n for t, s, n in zip(new, spans, old.to_pylist(), strict=True)
                ]
                columns["n_chars"] = pa.array(counted, old.type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.select("__row", "__spans").mapInArrow(run, docs.schema)
