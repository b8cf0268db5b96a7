"""Sections by headings and windows by meaning, against plain loops."""

import random
import re

import numpy as np
import pytest

from ragassay.functions.embedding import hashing_embedder
from ragassay.functions.sections import heading, sentences
from ragassay.operators import chunkers

DOCS = "doc_id bigint, text string"


def test_headings():
    for line, want in {
        "# One": (1, "One"), "  ###### Six ##  ": (6, "Six"), "####### seven": None, "#none": None, "# ##": None, "": None,
        "1 Scope": (1, "Scope"), "1. Scope": (1, "Scope"), "2.10.3 Deep part": (3, "Deep part"), "2019": None,
        "12 men came.": None, "3 " + "x" * 80: (1, "x" * 80), "3 " + "x" * 81: None, "1234 too many": None, "1..2 x": None,
    }.items():
        assert heading(line) == want, line


def by_visible_headings(text):
    """Path of a body: the headings before it that no later one of their level or above closes."""
    heads, bodies = [], {0: []}
    for line in text.split("\n"):
        if found := heading(line):
            heads.append(found)
            bodies[len(heads)] = []
        else:
            bodies[len(heads)].append(line)
    for n, lines in bodies.items():
        body = "\n".join(lines)
        if body.strip():
            seen = heads[:n]
            yield [t for k, (level, t) in enumerate(seen) if all(x > level for x, _ in seen[k + 1 :])], body


def random_text(r):
    lines = []
    for _ in range(r.randint(0, 25)):
        kind = r.random()
        if kind < 0.3:
            lines.append("#" * r.randint(1, 4) + f" H{r.randint(0, 99)}")
        elif kind < 0.4:
            lines.append(".".join(str(r.randint(1, 9)) for _ in range(r.randint(1, 4))) + f" N{r.randint(0, 99)}")
        else:
            lines.append(" ".join(r.choice(["sea", "coal", "", "rate"]) for _ in range(r.randint(0, 30))))
    return "\n".join(lines)


def test_sections_and_their_chunks(spark):
    r = random.Random(2)
    rows = [(i, random_text(r)) for i in range(60)] + [(100, None), (101, ""), (102, " \n\t"), (103, "# only"), (104, "plain"), (104, "plain"), (None, "# a\nb")]
    rows.append((105, "# long\n" + " ".join(f"w{k}" for k in range(60_000))))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    key = lambda x: (x[0] is None, str(x))
    got = [(x.doc_id, x.section_no, x.path, x.content) for x in chunkers.document_sections(docs).collect()]
    want = [(i, n, path, body) for i, t in rows for n, (path, body) in enumerate(by_visible_headings(t or ""))]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert chunkers.chunk_sections(docs.limit(0)).count() == 0
    pieces = chunkers.chunk_sections(docs, 80, 10).collect()
    for i, t in rows:
        if i is None or i == 104:
            continue
        mine = sorted((x for x in pieces if x.doc_id == i), key=lambda x: x.chunk_index)
        assert [x.chunk_index for x in mine] == list(range(len(mine)))
        for n, (path, body) in enumerate(by_visible_headings(t or "")):
            own = [x for x in mine if x.section_no == n]
            assert own and all(x.path == path and len(x.content) <= max(80, len(max(body.split(), key=len))) for x in own)
            if len(body) <= 80:
                assert [x.content for x in own] == [body]
            at = 0  # each piece follows in the body
            for x in own:
                at = body.index(x.content, max(0, at - 10))
                at += len(x.content)
    with pytest.raises(ValueError):
        chunkers.chunk_sections(docs, 10, 11)


def test_sentences():
    assert sentences(" One. Two!? Three 3.5 is\nline two… x. ") == ["One.", "Two!?", "Three 3.5 is", "line two…", "x."]
    assert sentences("") == sentences(" \n . ".replace(".", "")) == []


def by_loops(text, embed, percentile, longest):
    found = [s.strip() for s in re.findall(r"[^\n]*?[.!?…]+(?=\s)|[^\n]+", text) if s.strip()]
    if not found:
        return []
    vectors = [v / (np.linalg.norm(v) or 1) for v in embed(found, "").astype(float)]
    distances = [round(1 - float(a @ b), 9) for a, b in zip(vectors, vectors[1:])]
    limit = sorted(distances)[int(percentile * (len(distances) - 1))] if distances else 0
    out = [found[0]]
    for sentence, distance in zip(found[1:], distances):
        if distance > limit or len(out[-1]) + 1 + len(sentence) > longest:
            out.append(sentence)
        else:
            out[-1] += " " + sentence
    return out


@pytest.mark.parametrize("percentile, longest", [(0.5, 200), (0.9, 1000), (1.0, 60)])
def test_windows(spark, percentile, longest):
    r = random.Random(4)
    words = ["sea", "coal", "rate", "growth", "tide", "mine"]
    rows = []
    for i in range(50):
        text = "".join(" ".join(r.choice(words) for _ in range(r.randint(1, 9))) + r.choice([". ", "! ", "\n", "? "]) for _ in range(r.randint(0, 30)))
        rows.append((i, text))
    rows += [(90, None), (91, ""), (92, "one"), (93, "x" * 3000 + ". y. z"), (93, "x" * 3000 + ". y. z")]
    embed = hashing_embedder(32)
    got = chunkers.chunk_semantic(spark.createDataFrame(rows, DOCS), embed, percentile, longest).collect()
    want = [(i, n, w) for i, t in rows for n, w in enumerate(by_loops(t or "", embed, percentile, longest))]
    assert sorted(map(tuple, got)) == sorted(want)
