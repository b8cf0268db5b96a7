"""Importance resampling and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ragassay.llm import periodic, queries, resample

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def grams(text, lo, hi):
    terms = TERM.findall((text or "").encode().translate(LOWER))
    found = [b" ".join(terms[k : k + n]) for n in range(lo, hi + 1) for k in range(len(terms) - n + 1)]
    return len(terms), found


def resampled(rows, target, lo, hi, buckets, seed, percent, least):
    told = [(i, *grams(t, lo, hi)) for i, t in rows]
    number = lambda g: zlib.crc32(g) % buckets
    s = Counter(number(g) for _, _, found in told for g in found)
    t = Counter(number(g) for text in target for g in grams(text, lo, hi)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for i, n, found in told:
        weight = sum(gain[number(g)] for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    drawn = able[: len(able) * percent // 100]
    return [(*r, None) for r in out if r not in drawn] + [(*r, k + 1) for k, r in enumerate(drawn)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_crcs_of_spans():
    r = random.Random(1)
    for size in (1, 3, 63, 64, 65, 700, 5000):
        data = np.frombuffer(r.randbytes(size), np.uint8)
        starts = np.array([r.randrange(size) for _ in range(50)])
        ends = np.array([r.randint(a + 1, size) for a in starts])
        want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
        assert resample.span_crcs(data, starts, ends).tolist() == want
    data = np.frombuffer(r.randbytes(3_000_000), np.uint8)
    assert resample.span_crcs(data, np.array([7]), np.array([2_999_990])).tolist() == [zlib.crc32(data[7:2_999_990].tobytes())]


@pytest.mark.parametrize("lo, hi, buckets, percent, least", [(1, 1, 10_000, 10, 20), (1, 3, 997, 50, 1), (2, 2, 70_000, 100, 0)])
@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_resample(spark, make, request, which, lo, hi, buckets, percent, least):
    rows = request.getfixturevalue(which)
    target = [None, "", "bast cor, Dun fi", "word w1 w2 w3", rows[-1][1]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string")
    got = resample.resample(make(rows), frame, lo, hi, buckets, 2024, percent, least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert ordered(got.collect()) == ordered(resampled(rows, target, lo, hi, buckets, 2024, percent, least))


def test_resample_without_rows(spark, make):
    none = make([]).limit(0)
    assert resample.resample(none, none).count() == 0
    rows = [(1, "one two " * 20), (2, "three four " * 20), (2, "three four " * 20)]
    got = resample.resample(make(rows), none, percent=100).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3]


def test_ranks_when_reads_are_split_anew(spark, make, dealt_anew):
    rows = [(i, f"{'abcdefgh'[i % 8]} word " * 15) for i in range(400)]
    dealt_anew(resample)
    got = resample.resample(make(rows).repartition(23), make(rows[:3]), 1, 1, 100, 3, 50, 20).collect()
    assert ordered(got) == ordered(resampled(rows, [t for _, t in rows[:3]], 1, 1, 100, 3, 50, 20))


def test_sampling_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = queries.op11_importance_resampling(spark, sf)
    want = con.execute(queries.SQL["op11_importance_resampling"])
    assert ordered(got.select([c[0] for c in want.description]).collect()) == ordered(want.fetchall())


def brute_runs(words, least, times):
    """All maximal stretches, period by period."""
    best = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - a >= max(least, times * p):
                best.setdefault((a, i + p), p)
    return sorted(((a, e, p) for (a, e), p in best.items()), key=lambda r: (r[0], r[2]))


def described(doc_id, text, least, times, edit):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if edit and doc_id is not None and words and h % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, least, times)
    gone = {i for a, e, p in found for i in range(a + p, e)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_sequences():
    r = random.Random(5)
    for _ in range(400):
        least, times = r.choice([(24, 3), (6, 3), (4, 2), (9, 3), (2, 2)])
        sequences = []
        for _ in range(r.randint(1, 5)):
            k = r.choice([1, 2, 3, 8])
            s = [r.randrange(k) for _ in range(r.choice([0, 1, 5, 30, 120]))]
            if s and r.random() < 0.6:
                a, p = r.randrange(len(s)), r.randint(1, 9)
                s = s[:a] + [s[a + (i - a) % min(p, len(s) - a)] for i in range(a, len(s))] + s[: r.randint(0, 5)]
            sequences.append(s)
        found = periodic.find_runs([np.array(s, np.int64) for s in sequences], least, times)
        assert [list(map(tuple, f.tolist())) for f in found] == [brute_runs(s, least, times) for s in sequences]


def looping_rows():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 150)))) for i in range(60)]
    rows += [(60 + i, " ".join([f"w{k}" for k in range(9)] + ["x", "Y", "x"][: 1 + i % 3] * (8 + i) + ["end"] * (i % 2))) for i in range(12)]
    return rows + [(80, "same " * 24), (81, "same " * 23), (82, "  a   " * 30), (82, "  a   " * 30)]


@pytest.mark.parametrize("edit", [False, True])
def test_runs(make, odd, edit):
    rows = looping_rows() + [(i, t) for i, t in odd if len(t or "") < 1000]
    want = [(i, *described(i, t, 24, 3, edit)) for i, t in rows]
    got = periodic.runs(make(rows), edit=edit).collect()
    assert ordered((r.doc_id, [(s, s + n, p) for s, n, p in r.runs], r.collapsed) for r in got) == ordered(want)
    digests = []
    for i, found, text in want:
        top = min(((-(e - a) / p, a, p, e - a) for a, e, p in found), default=None)
        best = (top[1], top[3], top[2], 1000 * top[3] // top[2]) if top else (None,) * 4
        lines = "".join(f"{a},{e - a},{p}\n" for a, e, p in found)
        digests.append((i, len(found), *best, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, text))))
    assert ordered(periodic.run_digests(make(rows), edit=edit).collect()) == ordered(digests)


def test_runs_of_the_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, sf).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        if len(WORD.findall(docs[r.doc_id] or "")) > 900:
            continue  # quadratic
        found, text = described(r.doc_id, docs[r.doc_id], 24, 3, True)
        lines = "".join(f"{a},{e - a},{p}\n" for a, e, p in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_runs_of_long_and_no_texts(make, odd):
    assert periodic.runs(make([]).limit(0)).count() == 0
    looped = " ".join(f"w{i % 70_000}" for i in range(300_000))
    got = {r.doc_id: r for r in periodic.runs(make([(1, looped), (2, None), *[r for r in odd if r[0] == 8]])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 300_000, 70_000)] and len(got[1].collapsed.split()) == 70_000
    assert (got[2].runs, got[2].collapsed) == ([], "")
    assert [tuple(x) for x in got[8].runs] == [(0, 120_000, 5003)]
