"""Best-fit packing of token sequences, planned over the histogram of lengths.

The plan works on counts, not on documents: at most `capacity` lengths, each with the
number of pieces that have it. Best-fit decreasing over these counts gives segments,
each of which sends a range of ranks of one length to a range of sequences. Pieces get
their slots by a join on length and rank within the length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragassay.llm.common import durable, map_rows, texts_of

#: words kept with their ids in one worker
WORDS = 800_000

# The tokenizer cuts lower-cased text by this pattern. For letters up to U+017F its
# classes are spelled out, so that re finds the same pieces; other texts go to the
# tokenizer whole. Fixed values of word_bpe_49k.json.
_LETTERS = "a-zªµºß-öø-ſ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t-\r {_LETTERS}0-9]+")
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")


class Encoder(dict):
    """Little-endian 32-bit ids of a text; ids of words are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model sees bytes as printable characters
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = (chr(c) for c in range(0x180) if not 0x80 <= c < 0xA0)
        self.printable = {ord(c): level.pre_tokenize_str(c)[0][0] for c in plain}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        ids = [token.id for token in self.model.tokenize(word.translate(self.printable))]
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))
        return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end: int, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents cut into pieces."""
    last = np.array([end], "<u4").tobytes()

    def of_row(doc_id: int | None, text: str) -> Iterator[tuple]:
        ids = encoder(tokenizer).encode(text) + last
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            row = doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)
            yield (*row, np.frombuffer(part, "<u4").astype("i4")) if with_ids else row

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_rows(texts_of(docs), schema + ", ids array<int>" * with_ids, of_row)


def plan(counts: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing over (length, count).

    Segments (length, first rank, count, first sequence, offset, pieces per sequence):
    the piece of rank `first rank + i` goes to sequence `first sequence + i div per`,
    at `offset + (i mod per) * length`.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of sequences
    sizes: list[int] = []  # the keys of room, ascending
    segments, opened = [], 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, n))

    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                free, n = capacity, -(-(count - rank) // (capacity // length))
                first, opened = opened, opened + n
            else:
                free = sizes[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            per = free // length
            used = min(count - rank, per * n)
            segments.append((length, rank, used, first, capacity - free, per))
            full, rest = divmod(used, per)
            put(free - per * length, first, full)
            if rest:
                put(free - rest * length, first + full, 1)
            put(free, first + full + bool(rest), n - full - bool(rest))
            rank += used
    return segments


def place(rows: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with a length from 1 to capacity.

    Rows are written with their numbers first, as they are read twice. Ranks within a
    length are taken in buckets of row numbers, so that a length that many pieces share
    is spread; the histogram has at most `capacity` rows.
    """
    spark = rows.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the number is a column of the table: reads of it need not be split alike
    rows = durable(rows.withColumn("__row", F.monotonically_increasing_id())).withColumn(
        "__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int")
    )
    counts = durable(rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n"))
    segments = plan(((r["length"], r["n"]) for r in histogram.collect()), capacity)
    schema = "length bigint, first_rank bigint, n bigint, first_sequence bigint, at bigint, per bigint"
    columns = zip(*segments, strict=True) if segments else [[]] * 6
    slots = spark.createDataFrame(
        pa.table({f.split()[0]: pa.array(list(c), pa.int64()) for f, c in zip(schema.split(", "), columns, strict=True)}),
        schema,
    )
    ranked = rows.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__row")) - 1
    ).join(bases, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("base"))
    step = F.col("__rank") - F.col("first_rank")
    # as many segments as lengths and splits of ranges need, whatever the number of rows
    placed = ranked.join(F.broadcast(slots), "length").filter((step >= 0) & (step < F.col("n")))
    return placed.select(
        *[c for c in rows.columns if not c.startswith("__")],
        (F.col("first_sequence") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, with_ids: bool = False
) -> DataFrame:
    """Pack documents, each followed by the id `end`, into sequences of `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id,
    offset. Only documents longer than a sequence are cut. A null or empty text is one
    piece with the end id alone. Repeated rows are packed as often as they come; a null
    doc_id is carried along. An empty table gives an empty result; further columns are
    not read.
    """
    return place(pieces(docs, tokenizer, capacity, end, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, of what pack(with_ids=True) returns."""
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
