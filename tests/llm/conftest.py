import itertools
import random

import pytest

COLUMNS = "doc_id bigint, text string, version bigint, spans string, label string, n_chars bigint, __id int"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text), with further columns of names the operators use."""

    def frame(rows):
        return spark.createDataFrame(
            [(i, t, 1, "s", "l", -1 if t is None else len(t), 2) for i, t in rows], COLUMNS
        ).repartition(3)

    return frame


@pytest.fixture(scope="session")
def odd():
    """Nulls in every column, empty, blank, one-word and very long texts, repeated rows."""
    long = " ".join(f"w{i % 5003}" for i in range(120_000))
    return [
        (None, None), (None, "alone without id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"),
        (6, "Same Text"), (6, "Same Text"), (7, "same text"), (8, long), (9, long + " end"), (9, "other text of nine"),
        (10, "é x 中文 \U0001f600"),
    ]


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages and shared lines."""
    r = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("a", "e", "i", "or", "un", "st")]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    shared, lines = [text(60) for _ in range(3)], [text(8) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [text(r.randint(5, 90)) for _ in range(3)]
        if r.random() < 0.4:
            parts.insert(r.randint(0, 3), r.choice(shared))
        if r.random() < 0.5:
            at = r.randint(0, 8)
            parts += lines[at : at + r.randint(1, 5)]
        rows.append((i, "\n".join(parts)))
    for i in range(90, 150):
        base = rows[r.randint(0, 20)][1].split(" ")
        for _ in range(r.choice([0, 1, 2, 5, 9])):
            base[r.randrange(len(base))] = r.choice(words)
        rows.append((i, " ".join(base)))
    r.shuffle(rows)
    return rows


@pytest.fixture
def dealt_anew(spark, monkeypatch):
    """Let each written table of a module change how the next reads are split."""
    names = [f"spark.sql.files.{n}" for n in ("minPartitionNum", "openCostInBytes")]

    def arrange(module):
        write, parts = module.durable, itertools.cycle((1, 40, 3))

        def durable(df):
            done = write(df)
            spark.conf.set(names[0], str(next(parts)))
            return done

        spark.conf.set(names[1], "1")
        monkeypatch.setattr(module, "durable", durable)

    yield arrange
    for name in names:
        spark.conf.unset(name)
