"""Quality classifier on held-out labels; packing against the tokenizer and a plain packer."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ragassay.llm import nbsvm, packing
from ragassay.llm.queries import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = nbsvm.scores(docs, nbsvm.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    for quality in (0, 1):
        part = scored[scored.quality == quality]
        assert (part.predicted == quality).mean() > 0.95
    assert ((scored.score >= 0.5) == (scored.predicted == 1)).all() and scored.score.between(0, 1).all()
    ids = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint")
    out = {r.doc_id: r.h for r in ids.select("doc_id", nbsvm.held_out("doc_id").alias("h")).collect()}
    assert out == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)} | {None: False}


def test_held_out_labels_are_never_learnt(spark, make):
    rows = [(i, "good prose text" if i % 2 else "BAD!! BAD!! BAD!!") for i in range(200)]
    learnt = [(i, i % 2) for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    wrong = [(i, 1 - i % 2) for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    schema = "doc_id bigint, quality int"
    docs = make(rows)
    one = nbsvm.train(docs, spark.createDataFrame(learnt, schema))
    two = nbsvm.train(docs, spark.createDataFrame(learnt + wrong + [(None, 1), (3, None), (5, 7)], schema))
    assert (one.weight == two.weight).all() and one.bias == two.bias
    assert {r.predicted for r in nbsvm.scores(docs.filter("doc_id % 2 = 0"), one).collect()} == {0}
    assert nbsvm.keep_good(docs, one).count() == 100


def test_odd_documents_and_labels(spark, make, odd):
    docs, schema = make(odd), "doc_id bigint, quality int"
    for labels, score in (([], 0.5), ([(4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1)], 1.0)):
        model = nbsvm.train(docs, spark.createDataFrame(labels, schema))
        got = nbsvm.scores(docs, model).collect()
        assert len(got) == len(odd) and all(abs(r.score - score) < 1e-6 for r in got)
    assert nbsvm.scores(docs.limit(0), model).count() == 0
    # a label that differs between rows does not count
    model = nbsvm.train(docs, spark.createDataFrame([(4, 1), (4, 0)], schema))
    assert model.score(nbsvm.features("word")) == pytest.approx(0.5)


def test_margins_separate():
    rows = [np.array([1, 2, 9]), np.array([1, 3]), np.array([5, 6, 9]), np.array([5, 7])]
    model = nbsvm.fit(rows, np.array([1.0, 1, -1, -1]), np.ones(4))
    assert [model.margin(r) > 0 for r in rows] == [True, True, False, False]
    assert model.score(rows[0]) > 0.9 and model.score(rows[2]) < 0.1


def encoded(text):
    tokenizer = encoded.tokenizer = getattr(encoded, "tokenizer", None) or Tokenizer.from_file(TOKENIZER)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


STRANGE = [
    "It's we'll THEY'RE o'clock '' 's's 12ab 3.14 _x_ a\x1cb\x85c\xa0d",
    "é è Ñ ß İ ſ ﬁ ² ½ × ÷ ǅ ɏ ɐ Σίσυφος ΟΔΟΣ 中文 ไทย é ́",
    "<|endoftext|> a <|startoftext|>b <|x|> < | >",
    "tab\tnew\nline\r\n  many   blanks   end　",
    "emoji \U0001f600\U0001f1e9\U0001f1ea don't DON'T ''ll",
    "µ ª º å Å ķ Ķ aµb a²b",
]


@pytest.mark.parametrize("text", STRANGE)
def test_ids_are_the_tokenizers(text):
    got = np.frombuffer(packing.Encoder(TOKENIZER).encode(text), "<u4").tolist()
    assert got == encoded(text)


def test_every_low_letter_is_cut_as_the_tokenizer_does():
    own = packing.Encoder(TOKENIZER)
    for code in range(1, 0x260):
        text = f"a{chr(code)}b 1{chr(code)} {chr(code)}{chr(code)}!"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == encoded(text), hex(code)


def check_packing(rows, got, capacity):
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    lengths = 0
    for doc_id, text in rows:
        ids = [*encoded(text), 1]
        lengths += len(ids)
        parts = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        for r in parts:
            assert r.start == capacity * r.piece
            part = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-lengths // capacity)


def test_pack(spark, make, odd):
    rows = {i: t for i, t in odd if i is not None}
    rows |= {100 + i: " ".join(["word"] * n) for i, n in enumerate([4095, 4096, 4094, 8191, 1, 0, 300, 300, 300, 4000])}
    rows |= {200 + i: t for i, t in enumerate(STRANGE)}
    got = packing.pack(make(list(rows.items())), TOKENIZER).collect()
    used, bound = check_packing(rows.items(), got, 4096)
    assert used == bound
    # repeated rows and null ids are packed as often as they come
    assert packing.pack(make(odd), TOKENIZER).filter("piece = 0").count() == len(odd)
    assert packing.pack(make([]).limit(0), TOKENIZER).count() == 0


def test_pack_when_reads_are_split_anew(make, dealt_anew):
    rows = [(i, "word " * (i % 7)) for i in range(600)]
    dealt_anew(packing)
    got = packing.pack(make(rows).repartition(23), TOKENIZER, capacity=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    check_packing(rows, got, 16)


def test_sequences(spark, make):
    rows = [(i, " ".join(f"{i} {j}" for j in range(i))) for i in range(60)]
    packed = packing.pack(make(rows), TOKENIZER, capacity=64, end=7, with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(len(encoded(t)) + 1 for _, t in rows)


def best_fit(lengths, capacity):
    """One piece after the other, into the fullest sequence that has room."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_is_best_fit_over_counts():
    rng = np.random.default_rng(3)
    for _ in range(40):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 200)))
        counts = list(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True)), strict=True))
        slots, fill = [], {}
        for length, first, n, sequence, at, per in packing.plan(counts, capacity):
            for i in range(n):
                slots.append((length, first + i))
                fill.setdefault(sequence + i // per, []).append((at + i % per * length, length))
        assert sorted(slots) == [(v, i) for v, n in counts for i in range(n)]
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(fill) == best_fit(lengths.tolist(), capacity)


def test_the_fit_against_an_independent_solver():
    """Dense features, the dual problem by projected gradient steps."""
    r = np.random.default_rng(3)
    size, n = 60, 90
    labels = np.where(r.random(n) < 0.4, 1.0, -1.0)
    lean = np.where(r.random(size) < 0.5, 0.25, 0.1)
    there = np.array([r.random(size) < np.where(y > 0, lean, 0.35 - lean) for y in labels])
    rows = [np.flatnonzero(x) for x in there]
    model = nbsvm.fit(rows, labels, np.ones(n))
    shares = []
    for y in (1, -1):
        counts = np.ones(nbsvm.SIZE)
        counts[:size] += there[labels == y].sum(axis=0)
        shares.append(counts / counts.sum())
    ratio = np.log(shares[0] / shares[1])[:size]
    dense = there * ratio
    dense = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-6)
    dense = np.hstack([dense, np.ones((n, 1))])
    signed = dense * labels[:, None]
    dual, kernel = np.zeros(n), signed @ signed.T
    step = 1 / np.linalg.norm(kernel, 2)
    for _ in range(60_000):
        dual = np.clip(dual - step * (kernel @ dual - 1), 0, nbsvm.PENALTY)
    weight = signed.T @ dual

    def loss(margins, squared):
        return 0.5 * squared + nbsvm.PENALTY * np.maximum(0, 1 - labels * margins).sum()

    scale = np.where(ratio == 0, 1, ratio)
    own = np.append(model.weight[:size] / scale, model.bias)
    margins = np.array([model.margin(x) for x in rows])
    best = loss(dense @ weight, weight @ weight)
    assert best <= loss(margins, own @ own) <= 1.02 * best
    assert np.allclose(margins, dense @ weight, atol=0.1)
