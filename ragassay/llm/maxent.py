"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The words of the training documents are counted exactly. Up to HEAD of the most frequent
ones make up GROUPS groups: the most frequent are alone in theirs, the others share
groups of about equal mass, and all words beyond, known or not, are the last group. A
word's probability is

    P(class | context) * P(group | class, context) * P(word | group)

The first two factors are softmaxes over CLASSES classes and the SLOTS groups of a class.
Their features are hashed: the word before, the two words before (an n-gram), and the
second and third word before alone (skips); each owns ROWS rows of weights, for the
second factor keyed by the class too. The last factor is the smoothed share of a word in
its group. With all weights at zero the model is the smoothed unigram model.

Training: each round takes its share of the documents, every document once over all
rounds. A task runs gradient steps over its documents from the weights so far and hands
on the rows it has touched; a row's new weights are the mean over the tasks, weighted by
how often each met it. The model has a fixed size, whatever the corpus: it is what the
driver gathers and broadcasts (17 MB of weights, 2 MB of head words). Scores of tail
words need their counts: those are joined by word, over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import durable, mix, texts_of, words

CLASSES = SLOTS = 32
GROUPS = CLASSES * SLOTS
#: groups that words share; the last of them is the tail
SHARED = 128
#: words with a group of their own or a shared one, at most: the bound of what is broadcast
HEAD = 1 << 16
KINDS, BITS = 4, 14
ROWS = KINDS << BITS
BOUND = 10.0  # of a weight
ROUNDS = 2
#: tokens a training task should see, tokens of a gradient step, its rate
SHARE, STEP, RATE = 4_000_000, 1 << 14, 0.3
CHUNK = 1 << 20

END, START, TAIL = (np.uint64(h) for h in (0xE11D, 0x57A7, 0x7A11))
_SALTS = mix(np.arange(1, KINDS + 1, dtype=np.uint64))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text with an end behind, and where texts end."""
    _, ends, hashes = words("\n".join(texts), lower=True)
    bounds = np.cumsum([len(t.encode()) + 1 for t in texts])
    upto = np.searchsorted(ends, bounds - 1, "right")
    return np.insert(hashes, upto, END), upto + np.arange(1, len(texts) + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: how often it is a token of the texts; ends are counted as a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for part in _parts(batches):
            kept.append(np.unique(tokens(part.column("text").to_pylist())[0], return_counts=True))
            if sum(len(w) for w, _ in kept) > 1 << 21:
                kept = [_summed(kept)]
                if len(kept[0][0]) > 1 << 20:
                    yield _counted(kept.pop())
        if kept:
            yield _counted(_summed(kept))

    parts = docs.select("doc_id", "text").mapInArrow(run, "word bigint, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _summed(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, of = np.unique(np.concatenate([w for w, _ in kept]), return_inverse=True)
    return word, np.bincount(of, weights=np.concatenate([n for _, n in kept])).astype(np.int64)


def _counted(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": found[0].view(np.int64), "n": found[1]})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes, of one row at least."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 1024)
            while part.nbytes > CHUNK and part.num_rows > 1:
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            yield part


@dataclass
class Model:
    """Head words (sorted hashes) with group, log10(count + 1) and log10 share of the group;
    weights of both softmaxes with how often each row was met by a task."""

    head: np.ndarray
    group: np.ndarray
    seen: np.ndarray
    share: np.ndarray
    base: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray
    met: np.ndarray

    def groups(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the head words (-1: in the tail) and group of each token."""
        if not len(self.head):
            return np.full(len(hashes), -1), np.full(len(hashes), GROUPS - 1)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        at = np.where(self.head[at] == hashes, at, -1)
        return at, np.where(at >= 0, self.group[at], GROUPS - 1)

    def contexts(self, hashes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the context features (KINDS x tokens)."""
        known = np.where(at >= 0, hashes, TAIL)
        # three starts in front of each text
        padded = np.insert(known, np.repeat(np.concatenate(([0], ends[:-1])), 3), START)
        lengths = np.diff(ends, prepend=0)
        place = np.arange(len(hashes)) + 3 * np.repeat(np.arange(1, len(ends) + 1), lengths)
        one, two, three = (padded[place - k] for k in (1, 2, 3))
        pair = mix(one) + two
        return np.stack([mix(x ^ s) for x, s in zip((one, pair, two, three), _SALTS, strict=True)])

    def factors(self, context: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
        """Of both softmaxes: level, rows of weights (KINDS x tokens), probabilities before
        they are divided by their sum, the sum, and the right answer."""
        first, slot = group // SLOTS, group % SLOTS
        keyed = (context ^ mix(first.astype(np.uint64) + np.uint64(77))) * np.uint64(0x9E3779B97F4A7C15)
        for level, key, bias, answer in ((0, context, self.base[0], first), (1, keyed, self.base[1][first], slot)):
            at = (key >> np.uint64(64 - BITS)).astype(np.uint16)
            odds = self.weights[level, 0].take(at[0], axis=0)
            for k in range(1, KINDS):
                odds += self.weights[level, k].take(at[k], axis=0)
            odds += bias
            np.exp(odds, out=odds)
            yield level, at, odds, odds.sum(axis=1), answer

    def learn(self, context: np.ndarray, group: np.ndarray) -> None:
        """One gradient step."""
        for level, at, slope, total, answer in self.factors(context, group):
            slope /= total[:, None]
            slope[np.arange(len(group)), answer] -= 1
            for k in range(KINDS):
                order = np.argsort(at[k], kind="stable")
                rows = at[k][order]
                firsts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                rows = rows[firsts]
                # two singles are added at a time, as the parts of a complex number
                pairs = slope.take(order, axis=0).view(np.complex64)
                change = np.add.reduceat(pairs, firsts, axis=0).view(np.float32)
                met = self.met[level, k, rows] + np.diff(np.append(firsts, len(group))).astype(np.float32)
                self.met[level, k, rows] = met
                change *= (-RATE / np.sqrt(met))[:, None]
                change += self.weights[level, k].take(rows, axis=0)
                # bounded weights keep every power of e within single precision
                self.weights[level, k, rows] = np.clip(change, -BOUND, BOUND, out=change)

    def log10(self, context: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log10 P(group | context) of each token."""
        out = np.zeros(len(group))
        for a in range(0, len(group), STEP):
            part = group[a : a + STEP]
            for _, _, odds, total, answer in self.factors(context[:, a : a + STEP], part):
                out[a : a + STEP] += np.log10(odds[np.arange(len(part)), answer] / total)
        return out


@dataclass(frozen=True)
class Corpus:
    """What the counts say: tokens, different words, and those of them that the head holds."""

    counts: DataFrame
    tokens: int
    words: int
    head_tokens: int
    head_words: int

    @property
    def mass(self) -> int:
        """Smoothed mass of all words and the unknown one."""
        return self.tokens + self.words + 1

    @property
    def tail_mass(self) -> int:
        return self.mass - self.head_tokens - self.head_words


def untrained(docs: DataFrame) -> tuple[Corpus, Model]:
    """Counts of all training documents and a model without weights."""
    counts = durable(word_counts(docs))
    # counts on a scale of sixteenths of an octave: a thousand rows at most
    step = F.floor(F.log2("n") * 16)
    scale = counts.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")
    ).collect()
    least, taken = math.inf, 0
    for row in sorted(scale, reverse=True):
        taken += row["words"]
        if taken > HEAD:
            break
        least = row["step"]
    found = counts.filter(step >= (least if least < math.inf else 1 << 30)).collect()
    word = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in found], np.int64)
    corpus = Corpus(
        counts, sum(r["tokens"] for r in scale), sum(r["words"] for r in scale), int(n.sum()), len(n)
    )
    order = np.lexsort((word, -n))
    word, n = word[order], n[order]
    alone = GROUPS - SHARED
    group = np.arange(len(n))
    if len(n) > alone:
        upto = np.cumsum(n[alone:] + 1)
        group[alone:] = alone + np.minimum((upto - 1) * (SHARED - 1) // upto[-1], SHARED - 2)
    mass = np.bincount(group, weights=n + 1, minlength=GROUPS)
    share = np.log10((n + 1) / mass[group])
    mass[-1] = corpus.tail_mass
    mass = np.maximum(mass, 1e-9).reshape(CLASSES, SLOTS)
    of_class = mass.sum(axis=1)
    base = np.log(of_class / mass.sum()), np.log(mass / of_class[:, None])
    order = np.argsort(word)
    model = Model(
        word[order], group[order].astype(np.int16), np.log10(n[order] + 1.0), share[order],
        tuple(b.astype(np.float32) for b in base),
        np.zeros((2, KINDS, 1 << BITS, SLOTS), np.float32), np.zeros((2, KINDS, 1 << BITS), np.float32),
    )
    return corpus, model


def _stream(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and groups of the tokens, in steps of STEP."""
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in _parts(batches):
        hashes, ends = tokens(part.column("text").to_pylist())
        at, group = model.groups(hashes)
        rest.append((model.contexts(hashes, at, ends), group))
        size += len(group)
        if size < STEP:
            continue
        context, group = np.concatenate([c for c, _ in rest], axis=1), np.concatenate([g for _, g in rest])
        whole = size // STEP * STEP
        for a in range(0, whole, STEP):
            yield context[:, a : a + STEP], group[a : a + STEP]
        rest, size = [(context[:, whole:], group[whole:])], size - whole
    if size:
        yield np.concatenate([c for c, _ in rest], axis=1), np.concatenate([g for _, g in rest])


_TOUCHED = "row int, n float, tasks int, weights binary"


def _packed(row: np.ndarray, n: np.ndarray, tasks: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(row), 1 << 13):
        part = slice(a, a + (1 << 13))
        size = len(row[part])
        offsets = pa.py_buffer((np.arange(size + 1, dtype=np.int32) * (4 * SLOTS)).tobytes())
        data = pa.py_buffer(np.ascontiguousarray(weights[part], "<f4").tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "row": row[part].astype(np.int32),
                "n": n[part].astype(np.float32),
                "tasks": tasks[part].astype(np.int32),
                "weights": pa.Array.from_buffers(pa.binary(), size, [None, offsets, data]),
            }
        )


def _unpacked(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("weights").to_pylist()), "<f4").reshape(-1, SLOTS)


def trained_round(docs: DataFrame, model: Model, shares: int) -> Model:
    """The model after gradient steps over docs in at most so many tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = sent.value
        local = replace(first, weights=first.weights.copy(), met=first.met.copy())
        for context, group in _stream(local, batches):
            local.learn(context, group)
        n = (local.met - first.met).ravel()
        row = np.flatnonzero(n)
        yield from _packed(row, n[row], np.ones(len(row)), local.weights.reshape(-1, SLOTS)[row])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tasks, total = np.zeros(2 * ROWS), np.zeros(2 * ROWS), np.zeros((2 * ROWS, SLOTS), np.float32)
        for batch in batches:
            row, times = batch.column("row").to_numpy(), batch.column("n").to_numpy()
            np.add.at(total, row, _unpacked(batch) * times[:, None])
            np.add.at(n, row, times)
            np.add.at(tasks, row, batch.column("tasks").to_numpy())
        row = np.flatnonzero(n)
        yield from _packed(row, n[row], tasks[row], total[row] / n[row, None].astype(np.float32))

    touched = docs.select("doc_id", "text").coalesce(shares).mapInArrow(run, _TOUCHED)
    # every row once: the model's size bounds what the driver gets
    found = touched.repartition("row").mapInArrow(mean, _TOUCHED).toArrow()
    weights, met = model.weights.copy(), model.met.copy()
    row = found.column("row").to_numpy()
    weights.reshape(-1, SLOTS)[row] = _unpacked(found)
    met.reshape(-1)[row] += found.column("n").to_numpy() / found.column("tasks").to_numpy()
    sent.unpersist()
    return replace(model, weights=weights, met=met)


def train(docs: DataFrame) -> tuple[Corpus, Model]:
    """Counts and model of all texts of docs."""
    rows = texts_of(docs)
    corpus, model = untrained(rows)
    shares = max(1, math.ceil(corpus.tokens / ROUNDS / SHARE))
    for k in range(ROUNDS):
        own = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(5)), F.lit(ROUNDS)) == k
        model = trained_round(rows.filter(own), model, shares)
    return corpus, model


_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_head bigint, seen double, model double, "
    "tail array<bigint>, times array<int>"
)


def scores(docs: DataFrame, corpus: Corpus, model: Model, held_out: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Tokens are the words (runs without ASCII white space, A-Z lower-cased) and an end, also
    of null and empty texts. base_score is the log10 probability of the smoothed unigram
    model, score that of the trained one, in which unknown words are one word of the tail.
    Repeated rows are scored each on its own. An empty table gives an empty result; further
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        seen, share = np.append(own.seen, 0.0), np.append(own.share, 0.0)  # place -1: tail
        for part in _parts(batches):
            hashes, ends = tokens(part.column("text").to_pylist())
            firsts = np.concatenate(([0], ends[:-1]))
            at, group = own.groups(hashes)
            logs = own.log10(own.contexts(hashes, at, ends), group) + share[at]
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            tail = np.flatnonzero(at < 0)
            order = np.lexsort((hashes[tail], doc[tail]))
            word, of = hashes[tail][order], doc[tail][order]
            new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])))[: len(word)])
            times = np.diff(np.append(new, len(word)))
            cuts = np.searchsorted(of[new], np.arange(len(ends) + 1)).astype(np.int32)
            columns = [
                part.column("doc_id"), part.column("held_out"), np.diff(ends, prepend=0),
                np.add.reduceat((at >= 0).astype(np.int64), firsts),
                np.add.reduceat(seen[at], firsts), np.add.reduceat(logs, firsts),
                pa.ListArray.from_arrays(cuts, pa.array(word[new].view(np.int64))),
                pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
            ]
            names = [c.split()[0] for c in _SCORED.split(", ")]
            yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)))

    held_out = F.lit(False) if held_out is None else held_out
    rows = texts_of(docs).select("doc_id", "text", held_out.alias("held_out"))
    scored = durable(rows.mapInArrow(run, _SCORED).withColumn("row", F.monotonically_increasing_id()))
    found = scored.select("row", F.inline(F.arrays_zip("tail", "times"))).withColumnRenamed("tail", "word")
    known = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    tails = found.join(corpus.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"),
        F.sum(known).alias("known"),
    )
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    n_tail = F.col("n_tokens") - F.col("n_head")
    return scored.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + known).alias("n_known"),
        F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (F.col("seen") + logs - F.col("n_tokens") * math.log10(corpus.mass)).alias("base_score"),
        (F.col("model") + logs - n_tail * math.log10(corpus.tail_mass)).alias("score"),
    )
