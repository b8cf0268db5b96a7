"""Fingerprints, dropout encoding, revisits and URL templates against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from ragassay.llm import dropout, revisit, simhash, urltree

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MASK = (1 << 64) - 1


# --- fingerprints -----------------------------------------------------------------


def hash_of(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value & MASK).to_bytes(8, "little")
    return xxhash.xxh64(data, seed=seed).intdigest()


def print_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    hashes = [hash_of(w) for w in words]
    found = hashes if len(hashes) < 2 else [hash_of(b, hash_of(a)) for a, b in zip(hashes, hashes[1:])]
    bits = 0
    for half, terms in enumerate((found, [hash_of(t) for t in found])):
        for j in range(64):
            if 2 * sum(t >> j & 1 for t in terms) > len(terms):
                bits |= 1 << (j + 64 * (1 - half))
    return f"{bits:032x}"


def like(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


@pytest.mark.parametrize("ranges", ["2", "8", "40"])
def test_edited_pairs(spark, make, ranges, corpus):
    rows = sorted(corpus)[:60] + [(1000, ""), (1001, "é中\U0001f600x"), (1002, None), (1003, "one"), (1010, " "), (2000, "a b " * 900)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r.doc_id: r for r in simhash.edited_pairs(make(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows)
    texts = [(i, t or "") for i, t in rows]
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (print_of(text), print_of(edited))
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(like(r.fingerprint, print_of(after)))


def test_odd_pairs(make, odd):
    got = simhash.edited_pairs_with_neighbours(make(odd)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted(
        (i is None, i or 0, print_of(t or "")) for i, t in odd
    )
    assert all((r.near_next is None) == (r.doc_id is None) for r in got)
    assert simhash.edited_pairs_with_neighbours(make([]).limit(0)).count() == 0
    (alone,) = simhash.edited_pairs(make([(3, "a b c d")])).collect()
    # seven characters, the last three of which give way to the first three
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def test_within_radius(spark):
    r = random.Random(5)
    base = [r.getrandbits(128) for _ in range(40)]
    prints = list(base)
    for b in base:
        for flips in range(0, 10):
            x = b
            for j in r.sample(range(128), flips):
                x ^= 1 << j
            prints.append(x)
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(sign(x >> 64), sign(x & MASK)) for x in prints]
    df = spark.createDataFrame(rows + [(None, None)], "hi bigint, lo bigint")
    asked = spark.createDataFrame(rows[:60] + rows[:5], "hi bigint, lo bigint")
    for radius in (0, 3, 6):
        got = {(q.hi, q.lo): q.n_near for q in simhash.within_radius(df, asked, radius).collect()}
        assert got == {
            rows[k]: sum(bin(prints[k] ^ p).count("1") <= radius for p in prints) for k in range(60)
        }
    with pytest.raises(ValueError):
        simhash.within_radius(df, asked, 7)


# --- dropout encoding -------------------------------------------------------------

TEXTS = [
    "", "a", " ", "  a  b\n\nc", "Hello world, hello   again\t!", "é中文\U0001f600 <s> </s> <unk> <0x0A>",
    "\n", " \n ", "▁x▁", "x" * 300, "ab " * 90 + "z" * 200 + "qu" * 70, "l'été où 12345 67.89 ÀÉÎ", "\x00\x01",
]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_without_dropout_it_is_the_models_own_segmentation(corpus):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = dropout.Segmenter(MODEL, 3, 0.0)
    texts = TEXTS + [t for _, t in corpus[:40]]
    for text, ids in zip(texts, plain.encode([(1, t) for t in texts]), strict=True):
        # the model reads a U+2581 as a blank, which no decoding undoes
        if "▁" not in text:
            assert ids_of(ids) == model.encode(text), text


def test_agendas_agree_and_vary(corpus):
    some = dropout.Segmenter(MODEL, 11, 0.2)
    keys = sorted({(s, v) for _, t in corpus[:30] for s in dropout._STRETCH.findall("▁" + t.replace(" ", "▁")) for v in range(4)})
    cuts = {}
    for (stretch, variant), ids in zip(keys, some.together(keys), strict=True):
        assert ids_of(ids) == some.alone(stretch, variant)
        cuts.setdefault(stretch, set()).add(ids)
    assert sum(len(c) > 1 for c in cuts.values()) > len(cuts) / 3
    other = dropout.Segmenter(MODEL, 12, 0.2)
    texts = [(1, t) for _, t in corpus[:9]]
    assert some.encode(texts) != other.encode(texts)
    assert some.encode(texts) == dropout.Segmenter(MODEL, 11, 0.2).encode(texts[::-1])[::-1]
    assert some.encode([(1, texts[0][1])]) != some.encode([(2, texts[0][1])])


def test_encode_and_decode(make, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = make(rows)
    for rate in (0.0, 0.3):
        encoded = dropout.encode(docs, MODEL, seed=5, rate=rate)
        back = dropout.decode(encoded, MODEL).collect()
        want = sorted((i is None, i or 0, t or "") for i, t in rows)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == want
    trip = dropout.round_trip(docs, MODEL, seed=5, rate=0.3).collect()
    assert all(r.lossless for r in trip)
    assert dropout.encode(make([]).limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        dropout.Segmenter(MODEL, 0, 1.0)


def test_one_text_of_many_distinct_words():
    text = " ".join(f"{i:x}{i * 7919 % 1_000_003:06x}" for i in range(400_000))
    assert len(text) > 4_500_000
    (ids,) = dropout.Segmenter(MODEL, 5, 0.1).encode([(1, text)])
    assert dropout.vocabulary(MODEL).decode(ids_of(ids)) == text


M64 = (1 << 64) - 1


def mixed(h):
    for shift, times in ((32, True), (29, True), (32, False)):
        h ^= h >> shift
        h = h * 0xD6E8FEB86659FD93 & M64 if times else h
    return h


def plain_cut(model, stretch, salt, limit):
    """One stretch, looking at all pairs again for every merge."""
    ranks = {model.id_to_piece(i): (-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    symbols = [(c, k, k + 1) for k, c in enumerate(stretch)]
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, start, middle), (b, _, end) = symbols[k], symbols[k + 1]
            known = (len(a) > 1 or a in ranks) and (len(b) > 1 or b in ranks)
            if known and a + b in ranks and mixed(salt ^ mixed(start << 42 ^ middle << 21 ^ end)) >= limit:
                if best is None or ranks[a + b] < best[0]:
                    best = ranks[a + b], k
        if best is None:
            break
        k = best[1]
        symbols[k : k + 2] = [(symbols[k][0] + symbols[k + 1][0], symbols[k][1], symbols[k + 1][2])]
    out = []
    for piece, _, _ in symbols:
        if piece in ranks:
            out.append(ranks[piece][1])
        else:
            spelled = "\u2581" if piece == "\ud800" else piece
            out += [model.piece_to_id(f"<0x{byte:02X}>") for byte in spelled.encode()]
    return out


def test_against_a_plain_encoder(corpus):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    seed, rate = 9, 0.25
    some = dropout.Segmenter(MODEL, seed, rate)
    texts = [t for t in TEXTS if len(t) < 200] + [t[:150] for _, t in corpus[:8]]
    rows = [(None if k == 3 else 10 * k, t) for k, t in enumerate(texts)]
    for (doc_id, text), ids in zip(rows, some.encode(rows), strict=True):
        want = []
        key = mixed(seed ^ (0 if doc_id is None else doc_id + 1))
        shown = "\u2581" + text.replace("\u2581", "\ud800").replace(" ", "\u2581") if text else ""
        for place, stretch in enumerate(re.findall("\u2581*[^\u2581\n]+|\u2581+|\n", shown)):
            salt = (seed ^ zlib.crc32(stretch.encode("utf-8", "surrogatepass")) << 8 ^ mixed(key ^ place)) * 0x9E3779B97F4A7C15 & M64
            want += plain_cut(model, stretch, salt, int(rate * 2**64))
        assert ids_of(ids) == want, text


def test_every_occurrence_is_drawn_on_its_own(corpus):
    some = dropout.Segmenter(MODEL, 11, 0.2)
    for i, text in corpus[:20] + [(7, "thousandfold " * 500 + "-" * 64 + "internationalization " * 30)]:
        cut = dropout._STRETCH.findall("▁" + text.replace(" ", "▁"))
        variants = some.variants(i, len(cut)).tolist()
        want = [k for s, v in zip(cut, variants, strict=True) for k in some.alone(s, v)]
        assert ids_of(some.encode([(i, text)])[0]) == want
    # the rate holds in each run, and a word is cut in more and more ways
    for seed in range(8):
        segmenter = dropout.Segmenter(MODEL, seed, 0.1)
        whole = dropout.Segmenter(MODEL, 0, 0.0).encode([(0, "a")])[0]
        (ids,) = segmenter.encode([(3, " ".join("a" * 5000))])
        assert 0.08 < 1 - ids_of(ids).count(*ids_of(whole)) / 5000 < 0.12
        ids, sizes = segmenter.drawn(["▁internationalization"] * 2000, segmenter.variants(1, 2000))
        words = [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])]
        assert len(set(words[:200])) > 12 and len(set(words)) > 2 * len(set(words[:200]))


def test_usual_words_go_through_their_list_of_candidates(corpus, monkeypatch):
    some = dropout.Segmenter(MODEL, 11, 0.3)
    cut = [s for _, t in corpus[:60] for s in dropout.stretches_of(t) if len(s) <= 32]
    variants = some.variants(5, len(cut))
    want = [some.alone(s, v) for s, v in zip(cut[:4000], variants[:4000].tolist(), strict=True)]
    grids, kept = [], dropout.Grid
    monkeypatch.setattr(dropout, "Grid", lambda *a: grids.append(len(a[3])) or kept(*a))
    for _ in range(2):
        ids, sizes = some.drawn(cut, variants)
    assert sum(grids) < len(set(cut)) / 100
    got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got[:4000] == want


def test_lists_of_candidates_agree_with_a_heap():
    # pieces better than their parts ("▁the" than "the"), runs with crowds of candidates,
    # lengths around the limits, characters outside the vocabulary
    rng = np.random.default_rng(3)
    alphabet = [list("▁thean"), list("=-"), list("▁understigh"), list("aé中\ud800😀s")]
    cut = ["▁the", "▁that", "▁hand", "▁under", "▁thingshen", "=" * 16, "-" * 31, "-" * 32, "-" * 33, "=" * 64, "▁" * 32]
    for letters in alphabet:
        cut += ["".join(rng.choice(letters, n)) for n in rng.integers(1, 36, 300).tolist() + [31, 32, 33, 64]]
    for seed, rate in enumerate((0.0, 0.05, 0.3, 0.7, 0.97)):
        some = dropout.Segmenter(MODEL, seed, rate)
        variants = some.variants(seed, len(cut))
        ids, sizes = some.drawn(cut, variants)
        got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [some.alone(s, v) for s, v in zip(cut, variants.tolist(), strict=True)]
    assert not some.charted.all() and some.charted.mean() > 0.5


# --- revisits ---------------------------------------------------------------------

RECORD = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, headers map<string,string>, span int, near string"


def test_canonical(spark):
    cases = {
        "http://WWW.Example.org:80/a/?utm_source=x&b=2#frag": "example.org/a?b=2",
        "https://example.org/a?b=2": "example.org/a?b=2", "HTTP://a.b": "a.b", "": "", "x?utm_id=1": "x",
        "http://h/A/?gclid=1&utm_x=3": "h/A",
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = {r.url: r.c for r in df.select("url", revisit.canonical("url").alias("c")).collect()}
    assert got == cases | {None: None}


def resolved(records):
    out = []
    full = [r for r in records if r[3] == "response" and r[1] is not None and r[2] is not None]
    for i, url, ts, kind, etag, modified, headers in records:
        if kind != "revisit":
            continue
        past = [r for r in full if url is not None and ts is not None and r[1] == url and r[2] < ts]
        if not past:
            out.append((i, None, "no response", None))
            continue
        of = max(past, key=lambda r: (r[2], r[0]))
        weak = lambda t: t.removeprefix("W/")
        if etag and of[4]:
            state = "resolved" if weak(etag) == weak(of[4]) else "changed"
        elif modified and of[5]:
            state = "resolved" if modified == of[5] else "changed"
        else:
            state = "no validator"
        good = state == "resolved"
        merged = {**(of[6] or {}), **{k: v for k, v in (headers or {}).items() if k in revisit.PERMITTED}}
        out.append((i, of[0] if good else None, state, merged if good else None))
    return sorted(out, key=str)


def test_resolve(spark):
    r = random.Random(2)
    records = []
    for i in range(600):
        records.append((
            i, r.choice(["hot", "hot", f"u{r.randint(0, 9)}", None]), r.choice([r.randint(-300, 3000), r.randint(0, 40), None] if i % 40 == 0 else [r.randint(-300, 3000)]),
            r.choice(["response", "revisit", "revisit", "other", None] if i % 9 == 0 else ["response", "revisit"]),
            r.choice([None, "a", "W/a", "b"]), r.choice([None, "d1", "d2"]),
            r.choice([None, {}, {"etag": "n", "server": "s", "date": str(i)}]),
        ))
    df = spark.createDataFrame([(*x, 1, "clash") for x in records], RECORD)
    for span in (1, 50, 86_400):
        got = sorted(((x.record_id, x.response_id, x.state, x.headers) for x in revisit.resolve(df, span).collect()), key=str)
        assert got == resolved(records)
    assert revisit.resolve(df.limit(0)).count() == 0


# --- URL templates ----------------------------------------------------------------


def judged(pages, labels, rules=urltree.RULES):
    """The documented rules of the tree, in plain Python."""
    seen = defaultdict(set)
    for d, q in labels:
        if d is not None and q in (0, 1):
            seen[d].add(q)
    bad_of = {d: 1 - min(q) for d, q in seen.items() if len(q) == 1}
    rows = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        parts = [p for p in path.split("/") if p]
        n = re.search("[0-9]+", path)
        rows.append([i, host, path, parts, bad_of.get(int(n[0])) if n and len(n[0]) <= 18 else None])
    # the different paths of a node are named together, level by level
    names, d = {(row[1], tuple(row[3])): () for row in rows}, 0
    while any(len(parts) > d for _, parts in names):
        nodes = defaultdict(list)
        for (host, parts), name in names.items():
            if len(parts) > d:
                nodes[host, name].append((host, parts))
        for (_, name), paths in nodes.items():
            own = {p[1][d] for p in paths}
            mask = lambda x: re.sub("[0-9]+", "*", x)
            alike = Counter(map(mask, own))
            child = {x: (mask(x), True) if mask(x) != x and alike[mask(x)] >= 2 else (x, False) for x in own}
            below = Counter(child[p[1][d]] for p in paths)
            rare = {c for c, n in below.items() if not c[1] and n <= 2}
            for p in paths:
                c = child[p[1][d]]
                names[p] = (*name, "*" if c in rare and len(rare) >= 8 else c[0])
        d += 1
    name = [names[row[1], tuple(row[3])] for row in rows]

    def total(key):
        sums = defaultdict(lambda: [0, 0])
        for k, row in enumerate(rows):
            if row[4] is not None:
                s = sums[key(k)]
                s[0] += 1
                s[1] += row[4]
        return sums

    host = lambda k: rows[k][1]
    parent = lambda k: (host(k), tuple(name[k][:-1]))
    own, over = total(lambda k: (*parent(k), tuple(name[k]))), total(parent)
    branch = []
    for k in range(len(rows)):
        tl, tb = own[(*parent(k), tuple(name[k]))]
        pl, pb = over[parent(k)]
        share = pb / pl if pl else 0.0
        off = abs(tb - tl * share)
        branch.append((*parent(k), off * off <= tl * share * (1 - share) * 4 or tuple(name[k])))
    groups, hosts, every = total(lambda k: branch[k]), total(host), total(lambda k: 0)[0]
    corpus = every[1] / every[0] if every[0] else 0.0
    out = []
    for k, (i, h, path, *_ ) in enumerate(rows):
        prior = (hosts[h][1] + urltree.CORPUS_WEIGHT * corpus) / (hosts[h][0] + urltree.CORPUS_WEIGHT)
        impurity = (groups[branch[k]][1] + urltree.HOST_WEIGHT * prior) / (groups[branch[k]][0] + urltree.HOST_WEIGHT)
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        says = rule[2] if rule else "block" if impurity > 0.5 else "allow"
        out.append((i, h, path, rule and rule[0] + rule[1], says, "".join("/" + n for n in name[k])))
    return sorted(out, key=str)


def templates_of(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    return {r.page_id: r.template for r in urltree.judge(pages, labels).collect()}


def test_slugs_beside_large_sections_and_repeated_captures(spark):
    slugs = [f"http://h.example/item-{c}/z" for c in "abcdefghijklmnop"]
    noise = [f"http://h.example/{s}/{c}{c}" for s in ("x", "w") for c in "abcdefghijklm"]
    got = templates_of(spark, slugs + noise)
    assert {got[i] for i in range(16)} == {"/*/z"}
    assert {got[i] for i in range(16, 42)} == {"/x/*", "/w/*"}
    # captures and queries that come again change nothing
    again = [f"{u}?q={n}" for u in slugs for n in range(7)]
    more = templates_of(spark, slugs + noise + again)
    assert {i: more[i] for i in got} == got and {more[i] for i in range(42, len(more))} == {"/*/z"}


def test_digits_are_one_kind_of_evidence(spark):
    urls = ["http://h/v2/a", "http://h/v2/b", "http://g/2021/a", "http://g/2022/a", "http://g/about", *[f"http://g/2021/p-{k}.html" for k in range(3)]]
    got = templates_of(spark, urls)
    assert [got[i] for i in range(8)] == ["/v2/a", "/v2/b", "/*/a", "/*/a", "/about", *["/*/p-*.html"] * 3]


def test_deep_paths(spark):
    deep = "/".join(f"s{c}" for c in "abcde" * 60)
    got = templates_of(spark, [f"http://h/{deep}/{k}/end" for k in range(5)] + [f"http://h/{deep}/x" for _ in range(2)])
    assert {got[i] for i in range(5)} == {f"/{deep}/*/end"} and got[5] == got[6] == f"/{deep}/x"


def test_judge(spark):
    r = random.Random(4)
    pages, labels = [], []
    for i in range(900):
        host = r.choice(["A.example.com", "b.org", "x.net", "example.net", "m.example.net", "notnet", "h.example.com"])
        part = r.choice(["en", "de", "fr", f"p{r.randint(0, 200)}x", "junk"])
        tail = r.choice(["", "/", f"/{i}", f"/{i}.html", f"/a/b/c/{i}/e/f", f"/{i}/t{r.choice('abcdefghijkl')}"])
        pages.append((i, f"http://{host}/{part}/{i}{tail}{r.choice(['', '?q=1/2', '#f'])}"))
        labels.append((i, int(part != "junk" and r.random() < 0.8) if r.random() < 0.9 else r.choice([None, 5])))
    pages += [(None, None), (5000, ""), (5001, "no scheme/en/"), (5002, "http://"), (5003, "://net/x"), (5004, "http://net"), (5004, "http://net"), (5005, "http://X.ORG/fr/é?a#b"), (5006, f"http://h/{'9' * 30}"), (5007, "http://h/" + "s/" * 400)]
    labels += [(1, 0), (1, 1), (None, 0)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id bigint, url string, host string, template string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = sorted(map(tuple, urltree.judge(df, marks).collect()), key=str)
    assert got == judged(pages, labels)
    assert {g[4] for g in got if g[3] is None} == {"allow", "block"}
    assert urltree.judge(df.limit(0), marks).count() == 0
    assert {g.verdict for g in urltree.judge(df, marks.limit(0)).filter("rule is null").collect()} == {"allow"}
    assert urltree.judge(df.select(F.lit(None).cast("bigint").alias("page_id"), F.lit(None).alias("url")), marks).count() == len(pages)
