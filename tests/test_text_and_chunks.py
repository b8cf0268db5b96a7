"""Pages, chunks, fingerprints, keys and small text expressions."""

import hashlib
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ragassay.functions.chunking import split_text
from ragassay.functions.numbers import exact_mean, fixed_text, half_even
from ragassay.functions.text import name_uuid, preview, token_set
from ragassay.operators import ingest
from ragassay.sources.files import read_documents

PAGES = [
    "This is a long sentence that should definitely be chunked.",
    "  \n ",
    "Another sentence on the last page.",
]


def test_blank_page_is_skipped_and_keeps_its_number(spark):
    docs = spark.createDataFrame([(1, PAGES)], "doc_id int, pages array<string>")
    rows = ingest.chunk_documents(docs, "pages", size=50, overlap=10).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_number, r.content) for r in rows] == [
        (0, 1, "This is a long sentence that should definitely be"),
        (1, 1, "be chunked."),
        (2, 3, "Another sentence on the last page."),
    ]
    assert all(len(r.content) <= 50 for r in rows)


def test_empty_document_gives_no_chunks(spark):
    docs = spark.createDataFrame([(1, [""]), (2, None), (3, [" \n"])], "doc_id int, pages array<string>")
    assert ingest.chunk_documents(docs).count() == 0
    assert ingest.with_text(docs).count() == 0


def _pack(pieces, size, overlap):
    out, held = [], []
    for piece in pieces:
        if sum(map(len, held)) + len(piece) > size and held:
            out.append("".join(held).strip())
            while sum(map(len, held)) > overlap or (
                held and sum(map(len, held)) + len(piece) > size
            ):
                held.pop(0)
        held.append(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def _by_definition(text, separators, size, overlap):
    """The chunking rules spelled out on lists of strings."""
    sep = next(s for s in separators if s in text)
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        first, *rest = text.split(sep)
        pieces = [p for p in [first, *(sep + r for r in rest)] if p]
    else:
        pieces = list(text)
    out, run = [], []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        out += _pack(run, size, overlap)
        run = []
        out += _by_definition(piece, finer, size, overlap) if finer else [piece]
    return out + _pack(run, size, overlap)


def test_chunks_follow_the_definition():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("ab  \n\né") for _ in range(rng.randint(0, 70)))
        size = rng.randint(2, 20)
        overlap = rng.randint(0, size)
        got = split_text(text, size, overlap)
        assert got == _by_definition(text, ["\n\n", "\n", " ", ""], size, overlap)
        assert all(len(c) <= size for c in got)


def test_whole_test_documents_follow_the_definition(spark, sf):
    from ragassay.catalog import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["chunk_recursive"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for doc_id, text in texts.items():
        want = _by_definition(text, ["\n\n", "\n", " ", ""], 1000, 200) if text.strip() else []
        assert got.get(doc_id, []) == want


def test_overlap_larger_than_size_is_refused(spark):
    docs = spark.createDataFrame([(1, PAGES)], "doc_id int, pages array<string>")
    with pytest.raises(ValueError):
        ingest.chunk_documents(docs, size=5, overlap=6)


def test_document_file(spark, folder):
    content = "Page one text.\fPage two text.".encode()
    with open(f"{folder}/annual_report.txt", "wb") as f:
        f.write(content)
    row = read_documents(spark, folder).first()
    assert row.document_name == "annual_report.txt"
    assert row.md5_hash == hashlib.md5(content).hexdigest()
    assert row.total_pages == 2
    assert row.pages == ["Page one text.", "Page two text."]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_documents(spark, f"{folder}/missing").count()


@pytest.mark.parametrize("name", ["en", "src0", "Risk Management", "été ß 漢字 😀"])
def test_topic_key_is_a_version_5_uuid(spark, name):
    got = spark.range(1).select(name_uuid(F.lit(name))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_OID, name))


@pytest.mark.parametrize("value", [3.625, 0.125, 2.675, 1.005, 0.99, 4.270833333333333, 5.0, 0.0, 0.375])
def test_rounding_and_fixed_text_follow_python(spark, value):
    row = spark.range(1).select(half_even(F.lit(value), 2), fixed_text(F.lit(value), 2), fixed_text(F.lit(value), 4)).first()
    assert tuple(row) == (round(value, 2), f"{value:.2f}", f"{value:.4f}")


@pytest.mark.parametrize("text", ["2.6750", "3.6250", "0.1250", "9.9950", "0.0049"])
def test_fixed_text_of_decimals_follows_python(spark, text):
    got = spark.range(1).select(fixed_text(F.lit(Decimal(text)).cast("decimal(5,4)"), 2)).first()[0]
    assert got == f"{Decimal(text):.2f}"


def test_mean_is_exact_whatever_the_order(spark):
    df = spark.range(0, 30000, 1, 37).select((F.col("id") % 3 / 10).cast("decimal(5,4)").alias("v"))
    assert df.agg(exact_mean(F.col("v"))).first()[0] == 0.1


def test_preview(spark):
    df = spark.createDataFrame([("short\ntext",), ("x\n" * 60,)], "t string")
    got = [r[0] for r in df.select(preview(F.col("t"))).collect()]
    assert got == ["short\ntext", "x " * 50 + "..."]


def test_token_set(spark):
    df = spark.createDataFrame([("Été, été: a_b 3x!",)], "t string")
    assert sorted(df.select(token_set(F.col("t"))).first()[0]) == ["3x", "a", "b", "été"]
