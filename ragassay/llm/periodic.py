"""Periodic runs of words, found in an enhanced suffix array.

A run is a maximal stretch of words with a smallest period q. Its last square, two equal
halves of q words that end with the run, is a branching tandem repeat: the suffixes at
both halves agree in exactly q words. So they part in the suffix array at a place whose
longest common prefix is q, and all such pairs are found there: each place of the LCP
array splits the interval of suffixes that agree in at least so many words; for each
suffix i of the smaller side, the ranks of i + q and i - q tell whether the other half
lies on the other side. Taking the smaller sides only makes n log n tests at most. The
squares are rotated to the left as far as the words allow and give the runs. No tree is
built: intervals are found in range minima of the LCP array.

All steps are array operations over the words of many documents at a time. Documents
have words of their own there, so that nothing is compared beyond a document's end.
A run of 24 words and three periods makes two equal grams of 16 words, which is why
documents without such a pair need no suffix array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ragassay.llm.common import gram_hashes, mix, texts_of

LEAST, TIMES = 24, 3
#: words that share a suffix array (a longer document has one of its own), bytes of text
#: and suffixes of smaller sides taken at once
TOGETHER, CHUNK, TESTED = 200_000, 1 << 21, 1 << 20


class SuffixArray:
    """Suffixes of a sequence of non-negative numbers in order, by prefix doubling.

    ranks[k] numbers the different stretches of 2**k at each place, which compares any two
    equally long stretches in two look-ups.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        rank = np.unique(ids, return_inverse=True)[1]
        self.ranks, step = [rank.astype(np.int32)], 1
        order = np.argsort(rank, kind="stable")
        while rank.max() < n - 1:
            key = rank * np.int64(n + 1)
            key[: max(0, n - step)] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], sorted_key[1:] != sorted_key[:-1])))
            self.ranks.append(rank.astype(np.int32))
            step *= 2
        self.order, self.place, self.n = order, rank, n
        self.lcp = self._neighbours()

    def _neighbours(self) -> np.ndarray:
        """Words that each suffix shares with the one before it; -1 at both ends."""
        i, j = self.order[:-1], self.order[1:]
        shared = np.zeros(self.n - 1, np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + shared, j + shared
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = self.ranks[k][a[inside]] == self.ranks[k][b[inside]]
            shared[inside[same]] += 1 << k
        return np.concatenate(([-1], shared, [-1]))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at a and b (a < b) of that length are there and equal."""
        out = (a >= 0) & (b + length <= self.n)
        level = np.maximum(1, length)
        level = np.frexp(level.astype(float))[1] - 1  # the largest power of two within
        out &= level < len(self.ranks)
        for k in np.unique(level[out]).tolist():
            at = np.flatnonzero(out & (level == k))
            x, y, rest = a[at], b[at], length[at] - (1 << k)
            ranks = self.ranks[k]
            out[at] = (ranks[x] == ranks[y]) & (ranks[x + rest] == ranks[y + rest])
        return out | (length <= 0) & (a >= 0)

    def sides(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place left and last place right of a split, for splits of the LCP array.

        From split to first the prefixes are longer than at the split, to the right they
        are as long at least.
        """
        tables, width = [self.lcp], 1
        while 2 * width <= len(self.lcp):
            low = tables[-1]
            tables.append(np.minimum(low[:-width], low[width:]))
            width *= 2
        depth = self.lcp[at]
        first, last = at.copy(), at.copy()
        for k in range(len(tables) - 1, -1, -1):
            size, low = 1 << k, tables[k]
            back = first - size
            longer = np.flatnonzero(back >= 0)
            longer = longer[low[back[longer]] > depth[longer]]
            first[longer] -= size
            ahead = last + 1
            whole = np.flatnonzero(ahead + size <= len(self.lcp))
            whole = whole[low[ahead[whole]] >= depth[whole]]
            last[whole] += size
        return first - 1, last

    def squares(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and half of every branching tandem repeat with halves up to longest."""
        at = np.flatnonzero((self.lcp > 0) & (self.lcp <= longest))
        first, last = self.sides(at)
        depth = self.lcp[at]
        left = at - first <= last - at + 1
        low, high = np.where(left, first, at), np.where(left, at - 1, last)
        other_low, other_high = np.where(left, at, first), np.where(left, last, at - 1)
        sizes = high - low + 1
        starts, halves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        # a slice of splits at a time; one split has n / 2 suffixes at most
        block = np.cumsum(sizes) // TESTED
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = sizes[a:b]
            split = np.repeat(np.arange(a, b), size)
            rank = np.arange(len(split)) - np.repeat(np.cumsum(size) - size, size) + low[split]
            i, d = self.order[rank], depth[split]
            for start, half in ((i, i + d), (i - d, i - d)):
                inside = np.flatnonzero((half >= 0) & (half < self.n))
                of = split[inside]
                met = self.place[half[inside]]
                hit = inside[(met >= other_low[of]) & (met <= other_high[of])]
                starts.append(start[hit])
                halves.append(d[hit])
        return np.concatenate(starts), np.concatenate(halves)

    def runs(self, least: int, times: int) -> np.ndarray:
        """start, end, period of all runs of max(least, times * period) words or more."""
        start, period = self.squares(self.n // times)
        end = start + 2 * period
        # rotated left so far the square makes a run that is long enough
        need = np.maximum(least, times * period) - 2 * period
        enough = self.equal(start - need, start - need + period, need)
        start, period, end, need = start[enough], period[enough], end[enough], need[enough]
        step = 1 << max(0, int(start.max(initial=0)).bit_length())
        moved = need.copy()
        while step:
            further = moved + step
            ok = self.equal(start - further, start - further + period, further)
            moved = np.where(ok, further, moved)
            step >>= 1
        found = np.stack([start - moved, end, period], axis=1)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)  # of multiples of a period only the smallest
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        return found[new]


def find_runs(sequences: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """start, end, period of the runs of each sequence of small numbers, in order of start
    and period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(sequences)
    sizes = [len(s) for s in sequences]
    if not sum(sizes):
        return out
    top = np.cumsum([0, *(int(s.max(initial=-1)) + 1 for s in sequences)])
    ids = np.concatenate([s + t for s, t in zip(sequences, top, strict=False)])
    owner = np.repeat(np.arange(len(sequences)), sizes)
    # period q and length L: the grams at start and start + q agree in L - q words
    alike = max(1, min(least - least // times, (times - 1) * -(-least // times)))
    grams = gram_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), alike)
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    wanted = np.unique(owner[order[again]]).tolist()
    at = 0
    while at < len(wanted):
        part, n = [], 0
        while at < len(wanted) and (not part or n + sizes[wanted[at]] <= TOGETHER):
            part.append(wanted[at])
            n += sizes[wanted[at]]
            at += 1
        base = np.cumsum([0, *(sizes[k] for k in part)])
        found = SuffixArray(np.concatenate([sequences[k] + top[k] for k in part])).runs(least, times)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        cuts = np.searchsorted(found[:, 0], base)
        for k, b, lo, hi in zip(part, base, cuts, cuts[1:], strict=False):
            out[k] = found[lo:hi] - np.array([b, b, 0])
    return out


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """Places of the words of a document whose tail is made to loop; None if it stays.

    One document in ten is chosen by the CRC h of its decimal doc_id: from word a on the
    words a ... a + p - 1 are repeated. A null doc_id stays.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    last = {w: i for i, w in enumerate(words)}
    return np.fromiter(map(last.__getitem__, words), np.int64, len(words))


def described(docs: DataFrame, edit: bool, least: int, times: int, row, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 1024)
                while part.nbytes > CHUNK and part.num_rows > 1:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                kept, numbers = [], []
                for doc_id, text in zip(ids, texts, strict=True):
                    words = text.encode().split()  # of bytes: at ASCII white space only
                    places = looped(len(words), doc_id) if edit else None
                    number = _numbered(words)
                    if places is not None:
                        words = [words[i] for i in places.tolist()]
                        number = number[places]
                    kept.append(words)
                    numbers.append(number)
                found = find_runs(numbers, least, times)
                out = [row(*r) for r in zip(ids, kept, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)],
                    schema=arrow,
                )

    return texts_of(docs).mapInArrow(run, schema)


def _without(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by blanks, of each run only its first period."""
    if not len(found):
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 1], -1)
    stays = np.flatnonzero(np.cumsum(dropped)[:-1] == 0)
    return b" ".join([words[i] for i in stays.tolist()])


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, runs (array of start, length, period, in order
    of start and period), collapsed (the words joined by one blank, without what a run
    repeats after its first period).

    Words are runs without ASCII white space, compared by their bytes. Null and empty texts
    have no runs and an empty collapsed text; repeated rows are told alike, each on its own;
    very long texts take an array of their own, about 250 bytes for each word. With `edit`
    the tails of some documents loop first (see looped). An empty table gives an empty
    result; further columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("runs", kind), ("collapsed", pa.string())])

    def row(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
        told = [{"start": s, "length": e - s, "period": p} for s, e, p in found.tolist()]
        return doc_id, told, _without(words, found).decode()

    schema = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return described(docs, edit, least, times, row, schema, arrow)


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: bool = False) -> DataFrame:
    """Digests of runs: doc_id, n_runs, start, length, period, exponent_milli of the run with
    the greatest length / period (ties: smallest start, then period; nulls without a run),
    runs_sha256, collapsed_sha256."""
    numbers = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    digests = ["runs_sha256", "collapsed_sha256"]
    arrow = pa.schema([*((n, pa.int64()) for n in numbers), *((n, pa.string()) for n in digests)])

    def row(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
        told = [(s, e - s, p) for s, e, p in found.tolist()]
        best = (None,) * 4
        for s, n, p in told:  # in order of start and period: a tie stays with the first
            if best[0] is None or n * best[2] > best[1] * p:
                best = s, n, p, 1000 * n // p
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in told)
        texts = lines.encode(), _without(words, found)
        return doc_id, len(told), *best, *(hashlib.sha256(t).hexdigest() for t in texts)

    schema = ", ".join([*(f"{n} bigint" for n in numbers), *(f"{n} string" for n in digests)])
    return described(docs, edit, least, times, row, schema, arrow)
