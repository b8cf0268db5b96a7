"""Language-model scores: counts and base scores by brute force, the model as a distribution."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragassay.llm import maxent, queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return [*WORD.findall((text or "").translate(ASCII)), None]  # None: the end


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_rows(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        found = split(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found)
        yield i, held(i), len(found), sum(counts[w] > 0 for w in found), n, round(base, 6)


def run(docs):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    corpus, model = maxent.train(docs.filter(~held_out))
    return corpus, model, maxent.scores(docs, corpus, model, held_out)


def plain(rows):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in rows), key=repr)


@pytest.mark.parametrize("head", [1 << 16, 40])
@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_counts_and_base_scores(make, request, monkeypatch, which, head):
    monkeypatch.setattr(maxent, "HEAD", head)
    rows = request.getfixturevalue(which)
    _, model, scored = run(make(rows))
    assert len(model.head) <= head
    got = scored.collect()
    assert plain(got) == sorted(base_rows(rows), key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_no_rows_and_nothing_to_learn_from(make):
    assert run(make([]).limit(0))[2].count() == 0
    all_held = [(i, "some words") for i in range(100) if held(i)]
    got = run(make(all_held))[2].collect()
    assert len(got) == len(all_held) and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}


def test_without_training_the_model_is_the_base(make, corpus):
    docs = make(corpus)
    stats, model = maxent.untrained(maxent.texts_of(docs))
    for r in maxent.scores(docs, stats, model).collect():
        assert r.score == pytest.approx(r.base_score, rel=1e-6)


def by_hand(model, hashes, k, group):
    """log10 P(group | words before k), with loops."""
    known = [h if h in set(model.head.tolist()) else int(maxent.TAIL) for h in hashes.tolist()]
    one, two, three = ([int(maxent.START)] * 3 + known[:k])[::-1][:3]
    mixed = lambda x: int(maxent.mix(np.array([x], np.uint64))[0])
    pair = (mixed(one) + two) % 2**64
    keys = [mixed(x ^ mixed(n + 1)) for n, x in enumerate((one, pair, two, three))]
    own = mixed(group // maxent.SLOTS + 77)
    keyed = [(x ^ own) * 0x9E3779B97F4A7C15 % 2**64 for x in keys]
    total = 0.0
    for level, rows, bias, answer in (
        (0, keys, model.base[0], group // maxent.SLOTS),
        (1, keyed, model.base[1][group // maxent.SLOTS], group % maxent.SLOTS),
    ):
        odds = [
            float(bias[c]) + sum(float(model.weights[level, n, x >> 64 - maxent.BITS, c]) for n, x in enumerate(rows))
            for c in range(len(bias))
        ]
        total += odds[answer] - math.log(sum(map(math.exp, odds)))
    return total / math.log(10)


def test_the_model_is_a_distribution(make, corpus):
    stats, model, _ = run(make(corpus))
    assert np.abs(model.weights).max() > 0.1
    hashes, ends = maxent.tokens([corpus[0][1]])
    at, group = model.groups(hashes)
    context = model.contexts(hashes, at, ends)
    got = model.log10(context, group)
    for k in (0, 1, 2, 7, len(hashes) - 1):
        assert got[k] == pytest.approx(by_hand(model, hashes, k, int(group[k])), rel=1e-4)
        every = model.log10(np.repeat(context[:, k : k + 1], maxent.GROUPS, axis=1), np.arange(maxent.GROUPS))
        assert (10**every).sum() == pytest.approx(1, abs=1e-4)
    # words of a group share it whole; the tail keeps room for the unknown word
    shares = np.bincount(model.group, weights=10**model.share, minlength=maxent.GROUPS)
    assert all(s == pytest.approx(1) or s == 0 for s in shares)
    tail = stats.tokens - stats.head_tokens + stats.words - stats.head_words + 1
    assert stats.tail_mass == tail


def test_a_step_follows_the_slope(make, corpus):
    _, model = maxent.untrained(maxent.texts_of(make(corpus)))
    hashes, ends = maxent.tokens([t for _, t in corpus[:60]])
    at, group = model.groups(hashes)
    context = model.contexts(hashes, at, ends)
    losses = []
    for _ in range(5):
        losses.append(-model.log10(context, group).mean())
        model.learn(context, group)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] - 0.1
    # steps are cut alike however the texts come in
    frames = [pa.RecordBatch.from_pydict({"text": [t for _, t in corpus[a : a + n]]}) for a, n in ((0, 7), (7, 50), (57, 93))]
    cut = list(maxent._stream(model, iter(frames)))
    assert sum(len(g) for _, g in cut) == len(list(itertools.chain(*(split(t) for _, t in corpus))))


def test_what_was_learned_helps_with_held_out_documents(spark):
    got = queries.op12_maxent_scores(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000
    for part in (True, False):
        rows = [r for r in got if r.held_out is part]
        n = sum(r.n_tokens for r in rows)
        assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.05
