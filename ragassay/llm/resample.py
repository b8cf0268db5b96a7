"""Importance resampling of documents towards a target text collection.

Features are runs of consecutive words, each put into a bucket by the CRC of its bytes.
How much likelier a bucket is in the target than in the documents is its gain; a
document's weight is the sum of the gains of its features, and a Gumbel variable drawn
from a keyed hash makes the highest scores a sample without replacement.

The CRCs of many features are taken at once. Apart from a constant that depends on the
length only, a CRC is linear: the exclusive-or of one contribution for each byte, which
depends on the byte and its distance from the end. These contributions are a table of
WIDTH distances; the exclusive-or over each feature is one reduceat. Longer features are
cut into blocks of WIDTH bytes from their end; a block's value is moved on by the zero
bytes behind it, with one table for each power of two, and the blocks are folded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import durable, texts_of

WIDTH = 64
#: bytes of text taken at once, and blocks folded at once
CHUNK, BLOCKS = 1 << 20, 1 << 14

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def contributions() -> np.ndarray:
    """What a byte adds to a CRC, by distance from the end (rows) and byte."""
    zero = zlib.crc32(b"\0")
    table = np.empty((WIDTH, 256), np.uint32)
    table[0] = [zlib.crc32(bytes([b])) ^ zero for b in range(256)]
    for d in range(1, WIDTH):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ table[0][table[d - 1] & np.uint32(255)]
    return table


@lru_cache(maxsize=64)
def moved_on(power: int) -> np.ndarray:
    """Tables (one for each of the four bytes) that move a value on by WIDTH * 2**power zeros."""
    if power:
        table = moved_on(power - 1)
        return move(table.ravel(), table).reshape(4, 256)
    # a register of four bytes is what those bytes leave, WIDTH - 4 further zeros on
    return contributions()[WIDTH - 1 : WIDTH - 5 : -1].copy()


def move(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    out = table[0][values & low]
    for k in (1, 2, 3):
        out = out ^ table[k][values >> np.uint32(8 * k) & low]
    return out


@lru_cache(maxsize=4096)
def constant(length: int) -> int:
    """CRC of so many zero bytes: what the length alone makes."""
    return zlib.crc32(bytes(length))


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for many non-empty spans, which may overlap."""
    if not len(starts):
        return np.empty(0, np.uint32)
    lengths = ends - starts
    blocks = -(-lengths // WIDTH)
    firsts = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(starts)), blocks)
    behind = blocks[owner] - 1 - (np.arange(len(owner)) - firsts[owner])  # blocks after it
    high = ends[owner] - behind * WIDTH
    low = np.maximum(starts[owner], high - WIDTH)
    values = np.empty(len(owner), np.uint32)
    table = contributions().ravel()
    for a in range(0, len(owner), BLOCKS):
        lo, hi = low[a : a + BLOCKS], high[a : a + BLOCKS]
        size = hi - lo
        begin = np.cumsum(size) - size
        distance = np.repeat(begin + size - 1, size) - np.arange(int(size.sum()))
        at = np.repeat(hi - 1, size) - distance
        values[a : a + BLOCKS] = np.bitwise_xor.reduceat(table[distance << 8 | data[at]], begin)
    for power in range(int(behind.max()).bit_length()):
        far = np.flatnonzero(behind >> power & 1)
        values[far] = move(values[far], moved_on(power))
    sizes, of = np.unique(lengths, return_inverse=True)
    added = np.array([constant(n) for n in sizes.tolist()], np.uint32)
    return np.bitwise_xor.reduceat(values, firsts) ^ added[of]


def features(texts: list[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_words of each text; CRCs of all features, text by text, and where each text's begin."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    inked = _WORD[data]
    kept = inked.copy()
    kept[1:] |= inked[:-1]  # one separator after each word stays, as the blank
    bounds = np.cumsum([len(t) + 1 for t in raw])
    data, inked = np.where(inked, data, np.uint8(32))[kept], inked[kept]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inked.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    places = np.cumsum(kept)[bounds - 1]  # bytes that are left of the texts so far
    last = np.searchsorted(starts, places)
    n_words = np.diff(last, prepend=0)
    text = np.repeat(np.arange(len(texts)), n_words)
    crcs, owners = [], []
    for n in range(lo, hi + 1):
        at = np.arange(max(0, len(starts) - n + 1))
        at = at[text[at] == text[at + n - 1]]
        crcs.append(span_crcs(data, starts[at], ends[at + n - 1]))
        owners.append(text[at])
    owner = np.concatenate(owners)
    crc = np.concatenate(crcs)[np.argsort(owner, kind="stable")] if hi > lo else crcs[0]
    begins = np.searchsorted(np.sort(owner), np.arange(len(texts) + 1))
    return n_words, crc, begins


def bucket_table(docs: DataFrame, lo: int, hi: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, buckets (little-endian numbers of 2 or 4 bytes)."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())]
    )
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                n_words, crcs, begins = features(part.column("text").to_pylist(), lo, hi)
                data = (crcs % np.uint32(buckets)).astype(kind).tobytes()
                size = np.dtype(kind).itemsize
                cells = [data[size * a : size * b] for a, b in zip(begins, begins[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(np.diff(begins), pa.int64()),
                     pa.array(cells, pa.binary())],
                    schema=arrow,
                )

    return texts_of(docs).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes, of one row at least."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, 1024)
        while part.nbytes > CHUNK and part.num_rows > 1:
            part = part.slice(0, part.num_rows // 2)
        at += part.num_rows
        yield part


def _kind(buckets: int) -> str:
    if not 1 <= buckets <= 1 << 22:
        raise ValueError("from 1 to 2**22 buckets")
    return "<u2" if buckets <= 1 << 16 else "<u4"


def counts(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, n over a whole bucket table; a task hands on one row for each bucket at most."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_py(), kind), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": found, "n": total[found]})

    parts = table.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(likelihood ratio)) of each bucket; at most `buckets` rows reach the driver."""
    table = source.withColumnRenamed("n", "s").join(
        target.withColumnRenamed("n", "t"), "bucket", "full"
    )
    found = table.select("bucket", F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for bucket, n, m in found:
        s[bucket], t[bucket] = n, m
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of all features."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (np.frombuffer(cell.as_py(), kind) for cell in batch.column("buckets"))
            weight = pa.array([int(gain[cell].sum()) for cell in cells], pa.int64())
            names = ["doc_id", "n_words", "n_features", "weight"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:3]), weight], names=names)

    return table.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int) -> Column:
    """floor(1000 times a standard Gumbel variable), drawn from the hash of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((number + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """rows with rank 1, 2, 3 ... by falling score, then doc_id; null beyond `drawn`.

    The rows are sorted over the cluster and written with their place, so that a rank is
    the count of the parts before and the place within the own part.
    """
    placed = durable(
        rows.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), *[c for c in rows.columns if c not in ("score", "doc_id")])
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, passed = [], 0  # one row for each sorted part
    for row in sizes:
        before.append((row["part"], passed))
        passed += row["n"]
    offsets = rows.sparkSession.createDataFrame(before, "part bigint, passed bigint")
    rank = F.col("passed") + place + 1
    return placed.join(F.broadcast(offsets), part == offsets["part"]).select(
        *rows.columns, F.when(rank <= drawn, rank).alias("rank")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    lo: int = 1,
    hi: int = 2,
    buckets: int = 10_000,
    seed: int = 0,
    percent: int = 10,
    least_words: int = 20,
) -> DataFrame:
    """Draw percent/100 of the documents of least_words or more words that look like target.

    Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z; features
    are runs of lo to hi words, repeats counted. docs: doc_id, text; target: text. One row
    for each row of docs: doc_id, n_words, n_features, weight, score, rank (null if it is
    not drawn). Null, empty and wordless texts have weight 0. Equal scores rank by doc_id
    (null last), then by the other columns; repeated rows are ranked one after the other.
    An empty table gives an empty result, an empty target counts nothing. Further columns
    are not read.
    """
    if not 1 <= lo <= hi:
        raise ValueError("features have from 1 word on")
    table = durable(bucket_table(docs, lo, hi, buckets))
    wanted = bucket_table(target.select(F.lit(0).alias("doc_id"), "text"), lo, hi, buckets)
    gain = gains(counts(table, buckets), counts(wanted, buckets), buckets)
    scored = durable(weights(table, gain).withColumn("score", F.col("weight") + gumbel(seed)))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(able, drawn).unionByName(rest)
