"""Merge-dropout encoding and lossless decoding with a sentencepiece BPE vocabulary.

A text is cut before each run of blanks and around characters outside the vocabulary, as
no piece crosses these places. In a stretch, adjacent symbols that form a piece are
candidates of an agenda; the best-scored candidate (the leftmost of equals) is merged
first. Each candidate is skipped for good with the given rate, by a hash keyed with the
seed, the document, the stretch, its place and the candidate's three borders. A
merge makes new candidates with new borders. Every occurrence is drawn on its own, all
of them decode to the same text, and a run can be repeated to the last id.

What a stretch is cut into when nothing is skipped, and which merges do it, is remembered in
the worker, up to REMEMBERED bytes. An occurrence in which none of these merges is skipped
is cut like that. Of a stretch up to CHARTED characters all candidates that any draw can
lead to are remembered too, in the order in which agendas take them: an occurrence goes
through this list once. Where one list does not do, the agendas go on at once: a row for
each occurrence, one merge per step. Long stretches have a heap of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ragassay.llm.common import mix, texts_of

REMEMBERED = 200_000_000
LONG = 64  # characters of a stretch that gets its own heap
CHARTED = 32  # characters, and visits, of a stretch whose candidates are listed
VISITS = 128
#: widths of the rows in which short stretches are merged, and cells merged at once
WIDTHS = np.array([4, 6, 8, 10, 12, 16, 24, 32, 48, LONG])
CELLS = 1 << 16
SLICE = 100_000  # stretches drawn at once
SLOTS = 20  # bits of the hash of a pair
#: stands for a U+2581 of the text, which blanks become; no text holds it
_MARK = "\ud800"


class Vocabulary:
    """The pieces of a model, and all pairs of pieces that form a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [
            i for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {names[i]: i for i in normal}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.spelled = [name.replace("▁", " ").encode() for name in names]
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.spelled[i] = b""
        best = {i: rank for rank, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        pairs = {}
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                left, right = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (best[i], i)
        self.pairs = pairs
        self.keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        kind = np.int16 if n < 1 << 15 else np.int32  # small numbers are moved faster
        self.never = kind(np.iinfo(kind).max)
        self.ranks = np.array([r for r, _ in pairs.values()], kind)
        self.piece_of_rank = np.array(sorted(normal, key=lambda i: (-model.get_score(i), i)), kind)
        # pairs by hash: the first of each slot, then the next with that hash
        self.first, self.next = np.full(1 << SLOTS, -1, np.int32), np.full(len(pairs), -1, np.int32)
        slots = self._slot(self.keys)
        order = np.argsort(slots, kind="stable")
        same = slots[order[1:]] == slots[order[:-1]]
        self.next[order[:-1][same]] = order[1:][same]
        self.first[slots[order[np.concatenate(([True], ~same))[: len(order)]]]] = order[np.concatenate(([True], ~same))[: len(order)]]
        # ranks of pieces that are merged; 0 for a single character, which stands from the start
        self.rank_of = np.zeros(n, np.int64)
        self.rank_of[self.piece_of_rank] = np.arange(1, len(normal) + 1)
        self.rank_of[[i for name, i in self.ids.items() if len(name) == 1]] = 0
        self.longest = max([len(name) for name in self.ids], default=1)
        self.rank_bits = (len(normal) + 1).bit_length()
        self.symbols = np.full(0x110000, -1, kind)  # by code point
        for name, i in self.ids.items():
            if len(name) == 1:
                self.symbols[ord(name)] = i
        self.fallback: dict[str, list[int]] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair of symbols among those that form a piece, or -1."""
        wanted = left.astype(np.int64) << 20 | right
        found = self.first[self._slot(wanted)]
        open_ = np.flatnonzero(found >= 0)
        while len(open_):
            open_ = open_[self.keys[found[open_]] != wanted[open_]]
            found[open_] = self.next[found[open_]]
            open_ = open_[found[open_] >= 0]
        return found

    def spell(self, char: str) -> list[int]:
        """Ids of the bytes of a character outside the vocabulary."""
        if char not in self.fallback:
            if len(self.fallback) > 100_000:
                self.fallback.clear()
            self.fallback[char] = [self.bytes[b] for b in ("▁" if char == _MARK else char).encode()]
        return self.fallback[char]

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.spelled[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode()


_STRETCH = re.compile("▁*[^▁\n]+|▁+|\n")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stretches_of(text: str) -> list[str]:
    if not text:
        return []
    return _STRETCH.findall("▁" + text.replace("▁", _MARK).replace(" ", "▁"))


def _crc(stretch: str) -> int:
    return zlib.crc32(stretch.encode("utf-8", "surrogatepass"))


def _place(start, middle, end):
    """Mixed number of a candidate's borders; numbers or arrays of unsigned 64-bit values."""
    return mix((start << np.uint64(42)) ^ (middle << np.uint64(21)) ^ end)


def _keyed(salt, start, middle, end):
    """Hash of a candidate."""
    return mix(salt ^ _place(start, middle, end))


class Segmenter:
    def __init__(self, path: str, seed: int, rate: float):
        if not 0 <= rate < 1:
            raise ValueError("the rate is from 0 to below 1")
        self.words = vocabulary(path)
        self.seed = seed & (1 << 64) - 1
        self.limit = np.uint64(int(rate * 2**64))
        self.forget()

    def salts(self, stretches: list[str], variants) -> np.ndarray:
        """Keys of the draws of stretches with their variants."""
        return self._salts(np.array([_crc(s) for s in stretches], np.uint64), np.asarray(variants, np.uint64))

    def _salts(self, crcs: np.ndarray, variants: np.ndarray) -> np.ndarray:
        return (np.uint64(self.seed) ^ crcs << np.uint64(8) ^ variants) * np.uint64(0x9E3779B97F4A7C15)

    def variants(self, doc_id: int | None, n: int) -> np.ndarray:
        """A number for each of the n stretches of a document, by its place."""
        key = mix(np.array([self.seed ^ (0 if doc_id is None else doc_id + 1) & (1 << 64) - 1], np.uint64))
        return mix(key ^ np.arange(n, dtype=np.uint64))

    def encode(self, rows: list[tuple[int | None, str]]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [stretches_of(t) for _, t in rows]
        stretches = [s for c in cut for s in c]
        variants = np.concatenate(
            [np.empty(0, np.uint64), *(self.variants(d, len(c)) for (d, _), c in zip(rows, cut, strict=True))]
        )
        parts, sizes = [b""], [np.zeros(1, np.int64)]
        for a in range(0, len(stretches), SLICE):
            ids, size = self.drawn(stretches[a : a + SLICE], variants[a : a + SLICE])
            parts.append(ids.tobytes())
            sizes.append(size)
        data, upto = b"".join(parts), 4 * np.cumsum(np.concatenate(sizes))
        ends = upto[np.cumsum([0, *map(len, cut)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def forget(self) -> None:
        """Entries: what a stretch is cut into, places of the merges, CRC; characters and
        visits of those that are charted."""
        self.entries = Entries()
        self.ids, self.made = Ragged(np.uint32), Ragged(np.uint64)
        self.chars, self.visits = Ragged(np.uint32), Ragged(np.uint64)
        self.crcs, self.charted = np.empty(0, np.uint64), np.empty(0, bool)

    def learn(self, stretches: list[str]) -> None:
        crcs = np.array([_crc(s) for s in stretches], np.uint64)
        chars, visits, charted = self.listed(stretches)
        self.chars.add(*chars)
        self.visits.add(*visits)
        first = len(self.crcs)
        self.crcs, self.charted = np.append(self.crcs, crcs), np.append(self.charted, charted)
        rows, rest = np.flatnonzero(charted), np.flatnonzero(~charted)
        ids, made = self.followed(first + rows)
        others, met = self.merged([stretches[i] for i in rest.tolist()])
        self.ids.add(*_interleaved(len(stretches), [(rows, *ids), (rest, *others)]))
        self.made.add(*_interleaved(len(stretches), [(rows, *made), (rest, *met)]))

    def drawn(self, stretches: list[str], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches, one after the other, their merges drawn with their own
        variants; and how many each has."""
        # an entry has a text and a number besides its arrays
        held = 4 * (self.ids.size + self.chars.size) + 8 * (self.made.size + self.visits.size)
        if held + 240 * len(self.crcs) > REMEMBERED:
            self.forget()
        entry = np.fromiter(map(self.entries.__getitem__, stretches), np.int64, len(stretches))
        if self.entries.new:
            self.learn(self.entries.new)
            self.entries.new = []
        long = np.flatnonzero(entry < 0)
        known = np.flatnonzero(entry >= 0)
        again = np.zeros(len(known), bool)
        if self.limit:
            salts = self._salts(self.crcs[entry[known]], variants[known])
            places, sizes = self.made.get(entry[known])
            which = np.repeat(np.arange(len(known)), sizes)
            again[which[mix(salts[which] ^ places) < self.limit]] = True
            salts = salts[again]
        same, again = known[~again], known[again]
        groups = [(same, *self.ids.get(entry[same]))]
        if len(again):
            listed = self.charted[entry[again]]
            rows = again[listed]
            groups.append((rows, *self.followed(entry[rows], salts[listed])[0]))
            rows = again[~listed]
            groups.append((rows, *self.merged([stretches[i] for i in rows.tolist()], salts[~listed])[0]))
        if len(long):
            alone = [self.alone(stretches[i], int(variants[i])) for i in long.tolist()]
            ids = np.fromiter((k for a in alone for k in a), np.uint32)
            groups.append((long, ids, np.array([len(a) for a in alone], np.int64)))
        return _interleaved(len(stretches), groups)

    def listed(self, stretches: list[str]) -> tuple[tuple, tuple, np.ndarray]:
        """Characters and visits of the stretches, and which of them are charted."""
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        # a row, two ranks and starts, middle and end are one number of 64 bits
        most = 1 << max(0, 44 - 2 * self.words.rank_bits)
        short = np.flatnonzero(lengths <= CHARTED) if self.words.rank_bits <= 16 else np.empty(0, np.int64)
        chars, visits = [], []
        step = min(most, 2 * CELLS // (1 + int(lengths[short].mean()))) if len(short) else 1
        for a in range(0, len(short), step):
            part = short[a : a + step]
            text, number, sizes, good = _chart(self.words, [stretches[i] for i in part.tolist()])
            part, sizes = part[good], sizes[good]
            chars.append((part, text, lengths[part]))
            visits.append((part, number, sizes))
        charted = np.zeros(len(stretches), bool)
        for part, _, _ in chars:
            charted[part] = True
        return _interleaved(len(stretches), chars), _interleaved(len(stretches), visits, np.uint64), charted

    def followed(self, entries: np.ndarray, salts: np.ndarray | None = None) -> tuple[tuple, tuple]:
        """Ids of charted entries, one after the other, and how many each has. Without salts
        nothing is skipped, and the places of the merges come too, in the same form."""
        cut, made = [], []
        sizes = self.visits.sizes[entries]
        order = np.argsort(sizes, kind="stable")
        a = 0
        while a < len(order):
            # rows of about the same number of visits
            some = order[a : a + CELLS // 16]
            deep = np.arange(1, len(some) + 1) * np.maximum(sizes[some], 16)
            part = some[: max(1, int(np.searchsorted(deep, CELLS, "right")))]
            a += len(part)
            ids, merges = self._follow(entries[part], None if salts is None else salts[part])
            cut.append((part, *ids))
            if salts is None:
                made.append((part, *merges))
        return _interleaved(len(entries), cut), _interleaved(len(entries), made, np.uint64)

    def _follow(self, entries: np.ndarray, salts: np.ndarray | None) -> tuple[tuple, tuple | None]:
        words = self.words
        n, depths, lengths = len(entries), self.visits.sizes[entries], self.chars.sizes[entries]
        line = np.arange(int(depths.max()))[:, None]
        visit = self.visits.data[np.minimum(self.visits.starts[entries] + line, len(self.visits.data) - 1)]
        where = (visit & np.uint64(0x7FFF)).astype(np.int64)
        goes = line < depths
        if salts is not None:
            goes &= mix(salts ^ _PLACES[where]) >= self.limit
        # bits of the places where a piece begins: a candidate is there if its span has
        # these three only
        span, need, middle = _SPANS[where], _BORDERS[where], _MIDDLES[where]
        span *= goes
        state, kept, there = np.full(n, 0xFFFFFFFF, np.uint32), np.empty(n, np.uint32), np.empty(goes.shape, bool)
        for k in range(len(line)):
            np.bitwise_and(state, span[k], out=kept)
            np.equal(kept, need[k], out=there[k])
            np.multiply(middle[k], there[k], out=kept)
            np.bitwise_xor(state, kept, out=state)
        place = np.arange(max(1, int(lengths.max())))[:, None]
        chars = self.chars.data[self.chars.starts[entries] + np.where(place < lengths, place, 0)]
        symbol = words.symbols[chars]
        at = np.flatnonzero(there)  # later merges are written later
        piece = words.piece_of_rank[(visit.ravel()[at] >> np.uint64(15)).astype(np.int64)]
        symbol[where.ravel()[at] >> 10, at % n] = piece
        symbol[((state >> place.astype(np.uint32)) & np.uint32(1) == 0) | (place >= lengths)] = -2
        bound = np.broadcast_to(place.astype(np.int8), symbol.shape)
        ids = _ids(words, chars, symbol, bound)
        return ids, (_PLACES[where.T[there.T]], there.sum(axis=0)) if salts is None else None

    def alone(self, stretch: str, variant: int) -> list[int]:
        """One stretch, with a heap as its agenda."""
        words, salt = self.words, self.salts([stretch], [variant])[0]
        symbols = [words.ids.get(c, -1) for c in stretch]
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= len(symbols):
                return
            found = words.pairs.get((symbols[i], symbols[j]))
            if found and _keyed(salt, *np.array([i, j, after[j]], np.uint64)) >= self.limit:
                heapq.heappush(agenda, (found[0], i, j, after[j]))

        with np.errstate(over="ignore"):
            for i in range(len(symbols)):
                offer(i)
            while agenda:
                _, i, j, end = heapq.heappop(agenda)
                if symbols[i] == -2 or symbols[j] == -2 or after[i] != j or after[j] != end:
                    continue
                symbols[i] = words.pairs[symbols[i], symbols[j]][1]
                symbols[j] = -2
                after[i] = end
                if end < len(symbols):
                    before[end] = i
                if before[i] >= 0:
                    offer(before[i])
                offer(i)
        out = []
        for char, symbol in zip(stretch, symbols, strict=True):
            if symbol != -2:
                out += [symbol] if symbol >= 0 else words.spell(char)
        return out

    def together(self, keys: list[tuple[str, int]]) -> list[bytes]:
        """Many short stretches with their variants."""
        stretches = [s for s, _ in keys]
        ids, sizes = self.merged(stretches, self.salts(stretches, [v for _, v in keys]))[0]
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])]

    def merged(self, stretches: list[str], salts: np.ndarray | None = None) -> tuple[tuple, tuple]:
        """Ids of short stretches, one after the other, and how many each has. Without salts
        nothing is skipped, and the candidates met come too, in the same form, as mixed
        numbers of their borders."""
        cut, met = [], []
        codes, lengths = _codes(stretches)
        starts = np.cumsum(lengths) - lengths
        kind = np.searchsorted(WIDTHS, lengths)
        for k in np.unique(kind).tolist():
            rows, width = np.flatnonzero(kind == k), int(WIDTHS[k])
            step = CELLS // width
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                grid = Grid(self, codes, starts[part], lengths[part], width, None if salts is None else salts[part])
                cut.append((part, *grid.ids()))
                if salts is None:
                    met.append((part, *grid.candidates_met()))
        return _interleaved(len(stretches), cut), _interleaved(len(stretches), met, np.uint64)


class Entries(dict):
    """Numbers of stretches, given when one is first asked for; -1 for long ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        if len(stretch) > LONG:
            return -1
        self.new.append(stretch)
        number = self[stretch] = len(self)
        return number


class Ragged:
    """Rows of numbers of different lengths, one after the other."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 16, kind), 0
        self.starts, self.sizes, self.rows = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32), 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        upto, rows = self.size + len(data), self.rows + len(sizes)
        self.data = _longer(self.data, upto)
        self.starts, self.sizes = _longer(self.starts, rows), _longer(self.sizes, rows)
        self.data[self.size : upto] = data
        self.starts[self.rows : rows] = self.size + np.cumsum(sizes) - sizes
        self.sizes[self.rows : rows] = sizes
        self.size, self.rows = upto, rows

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[rows]
        return self.data[_spans(self.starts[rows], sizes)], sizes


def _longer(data: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy with room for n and half as many more."""
    return data if n <= len(data) else np.concatenate((data, np.empty(n + n // 2 - len(data), data.dtype)))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, sizes of them."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _interleaved(n: int, groups: list[tuple], kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """One ragged sequence of n rows from groups (rows, data, sizes)."""
    sizes = np.zeros(n, np.int64)
    for rows, _, size in groups:
        sizes[rows] = size
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), groups[0][1].dtype if groups else kind)
    for rows, data, size in groups:
        out[_spans(starts[rows], size)] = data
    return out, sizes


def _codes(stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the stretches, one after the other, and how many each has."""
    codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.fromiter(map(len, stretches), np.int64, len(stretches))


# by start, middle and end - 1 of a candidate, five bits each: mixed number of its borders; bits
# of the places in its span, of its borders, of its middle. The end of 32 places has no bit.
_START, _MIDDLE, _END = (np.arange(1 << 15) >> k & 31 for k in (10, 5, 0))
_PLACES = _place(*(x.astype(np.uint64) for x in (_START, _MIDDLE, _END + 1)))
_BORDERS = ((1 << _START) | (1 << _MIDDLE) | (1 << _END + 1)).astype(np.uint32)
_MIDDLES = (1 << _MIDDLE).astype(np.uint32)
_SPANS = ((1 << _END + 2) - (1 << _START)).clip(0).astype(np.uint32)


def _chart(words: Vocabulary, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of short stretches, all their candidates in the order in which agendas take
    them, how many each has, and whether it is charted.

    An agenda takes the best rank first, so that ranks rise, but for one case: a piece can be
    better than a part of it. Such a candidate is taken right behind the merge that made the
    part, before all others that are worse than itself. So the turn of a merge is a list of
    falling ranks with their starts: what it waited for, its own last. A merge goes behind
    the turns of its parts, without what is better than itself there. A candidate is visited
    at each turn that it can have, in their order; a visit at which it is not there does no
    harm, and one that is skipped or gone at its turn never comes back. Stretches with more
    than VISITS, or turns of more than four merges, are not charted.

    A visit is a number: rank from bit 15, start, middle, end - 1.
    """
    n, bits = len(stretches), words.rank_bits + 5
    lengths = np.fromiter(map(len, stretches), np.int64, n)
    # one after the other, with a place between them that is in no piece
    chars, _ = _codes([part for s in stretches for part in (s, "\n")])
    row_at = np.repeat(np.arange(n), lengths + 1)
    start_at = _spans(np.zeros(n, np.int64), lengths + 1)
    between = start_at == lengths[row_at]
    total = len(chars)
    symbol = {1: np.where(between, words.symbols.dtype.type(-1), words.symbols[chars])}
    places = {1: np.flatnonzero(symbol[1] >= 0)}
    sizes = min(int(lengths.max()), words.longest) + 1
    turns = Turns(sizes * total, bits)
    hard, count, visits = np.zeros(n, bool), np.zeros(n, np.int64), []
    for size in range(2, sizes):
        splits, cells = [], []
        for k in range(1, size):
            # look from the side of which there is less
            if len(places[k]) <= len(places[size - k]):
                at = places[k][: np.searchsorted(places[k], total - size, "right")]
                at = at[symbol[size - k][at + k] >= 0]
            else:
                at = places[size - k][np.searchsorted(places[size - k], k) :] - k
                at = at[symbol[k][at] >= 0]
            splits.append(np.full(len(at), k))
            cells.append(at)
        cell, split = np.concatenate(cells), np.concatenate(splits)
        left = np.concatenate([symbol[k][at] for k, at in enumerate(cells, 1)])
        right = np.concatenate([symbol[size - k][at + k] for k, at in enumerate(cells, 1)])
        found = words.pair(left, right)
        hit = np.flatnonzero((found >= 0) & ~hard[row_at[cell]])
        cell, split, left, right = cell[hit], split[hit], left[hit], right[hit]
        piece = words.piece_of_rank[words.ranks[found[hit]]]
        symbol[size] = np.full(total, -1, symbol[1].dtype)
        symbol[size][cell] = piece
        places[size] = np.flatnonzero(symbol[size] >= 0)
        if not len(hit):
            continue
        start, row = start_at[cell], row_at[cell]
        rank = words.rank_of[piece]
        own, tail = rank << 5 | start, (start + split) << 5 | (start + size - 1)
        none, waits = np.ones(len(hit), bool), []
        for part, ahead, long in ((left, 0, split), (right, split, size - split)):
            ranked, first = words.rank_of[part], start + ahead
            late = ranked > rank
            none &= ~late
            behind = np.flatnonzero(late)
            waits.append((behind, ranked[behind] << 5 | first[behind]))
            for which, before in turns.of(long * total + cell + ahead):
                # what the part waited for, and the part itself if it is worse than the piece
                before = turns.cut(before, rank[which])
                after = late[which]
                hard[row[which[after & turns.full(before)]]] = True
                before[after] = before[after] << bits | (ranked[which[after]] << 5 | first[which[after]])
                waits.append((which, before))
        which, before = (np.concatenate(x) for x in zip(*waits, strict=True))
        some = np.flatnonzero(before)
        if len(some):
            which, before = turns.add(size * total + cell, which[some], before[some])
            visits.append((row[which], before, own[which], tail[which]))
            count += np.bincount(row[which], minlength=n)
        some = np.flatnonzero(none)
        visits.append((row[some], np.zeros(len(some), np.int64), own[some], tail[some]))
        count += np.bincount(row[some], minlength=n)
        hard |= count > VISITS
    chars = chars[~between & ~hard[row_at]]
    if not visits:
        return chars, np.empty(0, np.uint64), np.zeros(n, np.int64), ~hard
    row, before, own, tail = (np.concatenate(x) for x in zip(*visits, strict=True))
    at = np.flatnonzero(~hard[row]) if hard.any() else slice(None)
    row, before, own, tail = row[at], before[at], own[at], tail[at]
    deep = np.zeros(n, bool)
    deep[row[before >> bits > 0]] = True
    simple = np.flatnonzero(~deep[row])
    # row, two ranks and starts, middle and end in one number
    first = np.where(before > 0, before << bits | own, own << bits)[simple]
    key = np.sort((row[simple] << 2 * bits + 10 | first << 10 | tail[simple]).astype(np.uint64))
    second = key >> np.uint64(10) & np.uint64((1 << bits) - 1)
    first = key >> np.uint64(bits + 10) & np.uint64((1 << bits) - 1)
    groups = [_visits(np.flatnonzero(~deep), key >> np.uint64(2 * bits + 10), np.where(second > 0, second, first), key & np.uint64(0x3FF), n)]
    some = np.flatnonzero(deep[row])
    if len(some):
        row, before, own, tail = row[some], before[some], own[some], tail[some]
        order = turns.order(row, before, own)
        groups.append(_visits(np.flatnonzero(deep), row[order], own[order].astype(np.uint64), tail[order].astype(np.uint64), n))
    return chars, *_interleaved(n, groups, np.uint64), ~hard


def _visits(rows: np.ndarray, row: np.ndarray, own: np.ndarray, tail: np.ndarray, n: int) -> tuple:
    number = ((own >> np.uint64(5)) - np.uint64(1)) << np.uint64(15) | (own & np.uint64(31)) << np.uint64(10) | tail
    return rows, number, np.bincount(row.astype(np.int64), minlength=n)[rows]


class Turns:
    """What the pieces of cells waited for: lists of up to three merges, each a rank and a
    start, the last one in the lowest bits."""

    def __init__(self, cells: int, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.head = np.full(cells, -1, np.int32)
        self.next, self.before = np.empty(0, np.int32), np.empty(0, np.int64)

    def of(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the cells that have one more list, with it."""
        which, node = np.arange(len(cells)), self.head[cells]
        while True:
            there = np.flatnonzero(node >= 0)
            if not len(there):
                return
            which, node = which[there], node[there]
            yield which, self.before[node]
            node = self.next[node]

    def cut(self, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The lists without what is better than the ranks."""
        for _ in range(3):
            before = np.where((before & self.mask) >> 5 > rank, before, before >> self.bits)
        return before

    def full(self, before: np.ndarray) -> np.ndarray:
        return before >> 2 * self.bits > 0

    def add(self, cell: np.ndarray, which: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keep the lists of cells; numbers and lists, each candidate's once."""
        order = np.lexsort((before, which))
        which, before = which[order], before[order]
        once = np.concatenate(([True], (which[1:] != which[:-1]) | (before[1:] != before[:-1])))
        which, before = which[once], before[once]
        cells = cell[which]
        order = np.lexsort((before, cells))
        cells, lists = cells[order], before[order]
        once = np.concatenate(([True], (cells[1:] != cells[:-1]) | (lists[1:] != lists[:-1])))
        cells, lists = cells[once], lists[once]
        node = np.arange(len(self.next), len(self.next) + len(cells), dtype=np.int32)
        # the lists of a cell follow each other
        after = np.where(np.append(cells[1:] == cells[:-1], False), node + 1, -1).astype(np.int32)
        first = np.concatenate(([True], cells[1:] != cells[:-1]))
        self.head[cells[first]] = node[first]
        self.next, self.before = np.append(self.next, after), np.append(self.before, lists)
        return which, before

    def order(self, row: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sorted by row, then by what was waited for and the merge itself."""
        bits, third = self.bits, before >> self.bits > 0
        fourth = self.full(before)
        # the first two merges, then the others; those of equal firsts share a number
        first = np.where(fourth, before >> bits, before)
        first = np.where(third, first, np.where(before > 0, before << bits | own, own << bits))
        then = np.where(fourth, (before & self.mask) << bits | own, np.where(third, own << bits, 0))
        first |= row << 2 * bits
        order = np.argsort(first)
        number = np.empty_like(order)
        number[order] = np.cumsum(np.append(0, np.diff(first[order]) != 0))
        return np.argsort(number << 2 * bits | then)


def _ids(words: Vocabulary, chars, symbol, bound) -> tuple[np.ndarray, np.ndarray]:
    """Ids of stretches from tables with a column for each, and how many each has."""
    symbol, bound = np.ascontiguousarray(symbol.T), bound.T
    there = symbol != -2
    sizes, ids = there.sum(axis=1), symbol[there].astype(np.uint32)
    odd = np.flatnonzero((symbol == -1).any(axis=1))
    if not len(odd):
        return ids, sizes
    groups, plain = [], np.ones(len(symbol), bool)
    plain[odd] = False
    for r in odd.tolist():
        spelled: list[int] = []
        for i, k in zip(symbol[r].tolist(), bound[r].tolist(), strict=True):
            if i != -2:
                spelled += [i] if i >= 0 else words.spell(chr(chars[k, r]))
        groups.append((np.array([r]), np.array(spelled, np.uint32), np.array([len(spelled)])))
    groups.append((np.flatnonzero(plain), ids[np.repeat(plain, sizes)], sizes[plain]))
    return _interleaved(len(symbol), groups)


class Grid:
    """Stretches of up to `width` characters; one merge in every stretch per step.

    A table has a column for each stretch, so that a step works on long rows: symbol[k, r] is
    the k-th symbol of stretch r (-1: outside the vocabulary, -2: none), which begins at
    bound[k, r]; rank is that of the pair of symbols k and k + 1.
    """

    def __init__(self, owner: Segmenter, codes, starts, lengths, width: int, salts: np.ndarray | None):
        self.owner, self.salts, self.met = owner, salts, []
        words, never = owner.words, owner.words.never
        place = np.arange(width)[:, None]
        chars = codes[np.minimum(starts + place, len(codes) - 1)]
        self.symbol = np.where(place < lengths, words.symbols[chars], words.symbols.dtype.type(-2))
        self.bound = np.minimum(np.arange(width + 1)[:, None], lengths).astype(np.int8)
        self.rank = np.full(self.symbol.shape, never)
        self.row = np.arange(len(lengths))
        self.chars, self.done = chars, (np.full_like(self.symbol, -2), np.zeros(chars.shape, np.int8))
        at, line = np.nonzero((self.symbol[:-1] >= 0) & (self.symbol[1:] >= 0))
        self.offer(line, at)
        while len(self.row):
            value = self.rank.min(axis=0)
            goes = value < never
            if not goes.all():
                ended = ~goes
                self.done[0][:, self.row[ended]] = self.symbol[:, ended]
                self.done[1][:, self.row[ended]] = self.bound[:-1, ended]
                self.symbol, self.bound, self.rank = (x[:, goes] for x in (self.symbol, self.bound, self.rank))
                self.row, value = self.row[goes], value[goes]
            if not len(value):
                break
            best = np.zeros(len(value), np.int8)
            for k in range(width - 2, -1, -1):  # the leftmost of equals is written last
                best[self.rank[k] == value] = k
            line = np.arange(len(best))
            self.symbol[best, line] = words.piece_of_rank[value]
            # what stands behind the merged pair moves up
            for k in range(1, width):
                moves = best < k
                np.copyto(self.bound[k], self.bound[k + 1], where=moves)
                if k < width - 1:
                    np.copyto(self.symbol[k], self.symbol[k + 1], where=moves)
                    np.copyto(self.rank[k], self.rank[k + 1], where=moves)
            self.symbol[-1], self.rank[-1] = -2, never
            # only the pairs at the merged symbol are new
            before = np.flatnonzero(best > 0)
            line, at = np.concatenate((line, before)), np.concatenate((best, best[before] - 1)).astype(np.int64)
            self.rank[at, line] = never
            self.offer(line, at)  # a merged pair has a place behind it

    def offer(self, line: np.ndarray, at: np.ndarray) -> None:
        """Rank the pairs that begin at the given symbols, if they form a piece and are not
        skipped."""
        left, right = self.symbol[at, line], self.symbol[at + 1, line]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        found = self.owner.words.pair(left[both], right[both])
        hit = np.flatnonzero(found >= 0)
        line, at, found = line[both[hit]], at[both[hit]], found[hit]
        place = _place(*(self.bound[at + k, line].astype(np.uint64) for k in range(3)))
        if self.salts is None:
            self.met.append((self.row[line], place))
        else:
            stays = mix(self.salts[self.row[line]] ^ place) >= self.owner.limit
            line, at, found = line[stays], at[stays], found[stays]
        self.rank[at, line] = self.owner.words.ranks[found]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return _ids(self.owner.words, self.chars, *self.done)

    def candidates_met(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.concatenate([r for r, _ in self.met])
        places = np.concatenate([p for _, p in self.met])[np.argsort(row, kind="stable")]
        return places, np.bincount(row, minlength=self.done[0].shape[1])


@lru_cache(maxsize=2)
def segmenter(path: str, seed: int, rate: float) -> Segmenter:
    return Segmenter(path, seed, rate)


def _encoded(docs: DataFrame, model: str, seed: int, rate: float, schema: str, arrow: pa.Schema, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = segmenter(model, seed, rate).encode
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # some texts at a time: enough for long arrays, few enough for memory
                part = batch.slice(at, 256)
                while part.nbytes > 4_000_000 and part.num_rows > 1:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                out = [row(*r, ids) for r, ids in zip(rows, encode(rows), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)],
                    schema=arrow,
                )

    return texts_of(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, seed: int = 0, rate: float = 0.1) -> DataFrame:
    """doc_id and ids (array<int>) for every row of docs.

    A null or empty text has no ids. Repeated rows get equal ids, equal texts of
    different documents differ in their cuts; a null doc_id counts as an id of its own.
    rate 0 gives the model's own segmentation. An empty table gives an empty result;
    further columns are not read.
    A U+2581 of a text is spelled by its bytes, as a character outside the vocabulary.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def row(doc_id: int | None, text: str, ids: bytes) -> tuple:
        return doc_id, np.frombuffer(ids, "<u4").astype(np.int32)

    return _encoded(docs, model, seed, rate, "doc_id bigint, ids array<int>", arrow, row)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are an empty text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = vocabulary(model).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [spell(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts)], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str, seed: int = 0, rate: float = 0.1) -> DataFrame:
    """Digests of encode and decode: doc_id, n_ids, ids_crc32, decoded_sha256, lossless."""
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def row(doc_id: int | None, text: str, ids: bytes) -> tuple:
        back = vocabulary(model).decode(np.frombuffer(ids, "<u4").tolist())
        digest = hashlib.sha256(back.encode()).hexdigest()
        return doc_id, len(ids) // 4, zlib.crc32(ids), digest, back == text

    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"
    return _encoded(docs, model, seed, rate, schema, arrow, row)
