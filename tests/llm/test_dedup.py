"""Exact, near, passage and line deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest

from ragassay.llm import minhash, radix, suffix, winnow
from ragassay.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(i):
    return (-1 << 70) if i is None else i


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(ASCII), []).append(i)
    return {
        t: (max(ids, key=low), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()
    }


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_exact_groups(make, request, which):
    rows = request.getfixturevalue(which)
    # texts that part late, at the borders of digits
    rows = rows + [(900 + i, "x" * n + tail) for i, (n, tail) in enumerate((n, t) for n in (63, 64, 65, 1023, 1024) for t in ("", "a", "b", "b"))]
    got = radix.exact_groups(make(rows)).collect()
    want = exact(rows)
    texts = {d: t for t, (_, _, d) in want.items()}
    assert sorted((low(r.doc_id), r.text_sha256) for r in got) == sorted(
        (low(i), want[(t or "").translate(ASCII)][2]) for i, t in rows
    )
    for r in got:
        assert (r.keep_id, r.group_size) == want[texts[r.text_sha256]][:2]
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(texts) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_groups_when_reads_are_split_anew(make, dealt_anew):
    rows = [(i, f"{i % 50} " + "same text " * 20) for i in range(400)]
    dealt_anew(radix)
    got = radix.exact_groups(make(rows).repartition(23)).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert sorted(r.doc_id for r in got if r.kept) == list(range(350, 400))


def test_empty_tables(make):
    none = make([]).limit(0)
    for run in (radix.exact_groups, minhash.near_groups, suffix.repeated_passages, suffix.cut_passages, winnow.drop_lines, minhash.keep_one_of_each):
        assert run(none).count() == 0


def sets(rows, k):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(ASCII))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        out.append((i, grams))
    return out


def near(rows, k=4):
    found = sets(rows, k)
    group = list(range(len(found)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, (_, x) in enumerate(found):
        for b in range(a):
            y = found[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(found):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted((low(i), len(s), low(least.get(root(a)) if s else i)) for a, (i, s) in enumerate(found))


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_near_groups(make, request, which):
    rows = request.getfixturevalue(which)
    got = minhash.near_groups(make(rows), shingle=4).collect()
    assert sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in got) == near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_bucket_whose_leaders_miss(make):
    """A chain: each document is near the next one only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 9 : i * 9 + 120])) for i in range(25)]
    got = minhash.near_groups(make(rows), shingle=4).collect()
    assert sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in got) == near(rows)
    assert {r.component_id for r in got} == {0}


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 5000):
        base = rng.integers(1, 2**63, n, dtype=np.uint64)
        assert len(np.unique(minhash.sketch(base))) <= minhash.SIZE
        assert (minhash.sketch(base) == minhash.sketch(base[::-1])).all()
    shared = rng.integers(1, 2**63, 600, dtype=np.uint64)
    errors = []
    for i in range(30):
        x = np.concatenate((shared, rng.integers(1, 2**63, 100, dtype=np.uint64)))
        y = np.concatenate((shared, rng.integers(1, 2**63, 100, dtype=np.uint64)))
        errors.append((minhash.sketch(x) == minhash.sketch(y)).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7), (20, 21), (21, 20)] + [(30 + i, 31 + i) for i in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {n: 1 for n in range(1, 6)} | {7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {30 + i: 30 for i in range(41)}


def later_windows(documents, least):
    """(row, position) of windows that occur earlier; rows in order."""
    seen, out = {}, set()
    for at, tokens in enumerate(documents):
        for s in range(len(tokens) - least + 1):
            key = tuple(tokens[s : s + least])
            if key in seen:
                out.add((at, s))
            seen.setdefault(key, (at, s))
    return out


def in_order(spark, rows):
    """Different rows by id and text hash, as the operators order them."""
    df = spark.createDataFrame(sorted({(i, t or "") for i, t in rows}, key=str), "doc_id bigint, text string")
    df.createOrReplaceTempView("in_order")
    found = spark.sql("SELECT *, xxhash64(text) v FROM in_order ORDER BY doc_id NULLS FIRST, v").collect()
    return [(r.doc_id, r.text, r.v) for r in found]


@pytest.mark.parametrize("which", ["odd", "corpus"])
@pytest.mark.parametrize("least", [12, 50])
def test_repeated_passages(spark, make, request, which, least):
    rows = request.getfixturevalue(which)
    ordered = in_order(spark, rows)
    tokens = [WORD.findall(t) for _, t, _ in ordered]
    want = {}
    for at, s in later_windows(tokens, least):
        want.setdefault(ordered[at][0::2], set()).update(range(s, s + least))
    got = {}
    for r in suffix.repeated_passages(make(rows), least).collect():
        got.setdefault((r.doc_id, r.version), set()).update(range(r.start_word, r.end_word))
    assert got == want


def test_passages_over_many_partitions(spark, make):
    """A passage in every document, and runs of copies across the borders of partitions."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(300)] + [(300 + i, passage) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = suffix.repeated_passages(make(rows), 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [
        (i, *((2, 72) if i < 300 else (0, 70))) for i in range(1, 600)
    ]
    assert all(r.source_doc_ids for r in got)


def test_cut_passages(make, corpus, odd):
    rows = corpus + [r for r in odd if r[0] is None or r[0] < 8]
    docs = make(rows)
    got = suffix.cut_passages(docs).collect()
    assert len(got) == len(rows) and got[0].__fields__ == docs.columns
    left = [WORD.findall(r.text or "") for r in sorted(got, key=lambda r: low(r.doc_id))]
    assert sum(map(len, left)) < sum(len(WORD.findall(t or "")) for _, t in rows)
    untouched = {(r.doc_id, r.text) for r in got} & set(rows)
    assert {(1, None), (2, ""), (3, " \n\t "), (4, "word")} <= untouched
    assert all(r.n_chars == len(r.text) for r in got if r.text)


def kept_lines(ordered, least, words=None):
    lines = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")] for _, t, _ in ordered]
    gone = [set() for _ in ordered]
    for at, s in later_windows([[x for _, x in doc] for doc in lines], least):
        gone[at].update(lines[at][s + k][0] for k in range(least))
    seen = set()
    for at, doc in enumerate(lines):
        for n, x in doc:
            if words is not None and x in seen and len(WORD.findall(x)) >= words:
                gone[at].add(n)
            seen.add(x)
    return {
        (i, v): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[at])
        for at, (i, t, v) in enumerate(ordered)
    }


@pytest.mark.parametrize("least, words", [(2, None), (3, 5), (3, 2), (5, None)])
def test_drop_lines(spark, make, corpus, odd, least, words):
    runs = [(500, "x\n" * 9), (501, "x\n\nx\ny\n x"), (502, "\n\n"), (503, "x\nx\nx")]
    runs += [(504, "a b c d e\nq"), (505, "z\na b c d e"), (506, "a b c d e \n a b c d e\na b c d\na b c d"), (507, "\ta b\na b\na b")]
    rows = corpus + odd + runs
    ordered = in_order(spark, rows)
    want = kept_lines(ordered, least, words)
    version = {(i, t): v for i, t, v in ordered}
    docs = make(rows)
    got = winnow.drop_lines(docs, least, words).collect()
    assert sorted((low(r.doc_id), r.text or "") for r in got) == sorted(
        (low(i), want[i, version[i, t or ""]]) for i, t in rows
    )
    assert got[0].__fields__ == docs.columns


def test_single_lines_pairs_and_one_line_copies(spark, make):
    rows = [(1, "a\nb\nc"), (2, "x\nb\ny"), (3, "only"), (4, "only"), (5, "a\nb"), (6, "\nz\n \nz"), (7, "")]
    got = {r.doc_id: r.text for r in winnow.drop_lines(make(rows), 1).collect()}
    assert got == {1: "a\nb\nc", 2: "x\ny", 3: "only", 4: "", 5: "", 6: "\nz\n ", 7: ""}
    want = {i: t for (i, _), t in kept_lines(in_order(spark, rows), 1).items()}
    assert got == want
    pairs = {r.doc_id: r.text for r in winnow.drop_lines(make(rows), 2).collect()}
    assert pairs == dict(rows) | {5: ""}
