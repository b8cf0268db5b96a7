"""SimHash fingerprints of 128 bits, and a search within a Hamming radius.

Terms are pairs of neighbouring words (the word itself if it is alone), weighted by how
often they occur: each occurrence votes on every bit of the fingerprint with the bits of
the term's hash. Votes are counted two to a 64-bit sum. All of it are column functions
and aggregates that combine within a document's own task.

Search: with BLOCKS blocks of 16 bits, two fingerprints that differ in at most
BLOCKS - 2 bits agree in at least two blocks. Each pair of blocks is a table, keyed by
its 32 bits; a pair is reported by the first table in which it agrees.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragassay.llm.common import durable, texts_of

BITS, BLOCKS = 128, 8
RADIUS = BLOCKS - 2
_LANES = 0x0000000100000001
WHITE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Hashes of neighbouring word pairs; of the word if there is one only."""
    words = F.array_remove(F.split(text, WHITE), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(hashes)
    pairs = F.zip_with(
        F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(hashes, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.xxhash64(a, b),
    )
    return F.when(n < 2, hashes).otherwise(pairs)


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, copies, hi, lo: the fingerprint of each row's text; rows of equal keys, which
    must have equal texts, are counted and come once. A text without words has no bits."""
    dealt = rows.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("at", "term"))
    dealt = dealt.select(
        *keys,
        (F.coalesce("at", F.lit(0)) == 0).cast("bigint").alias("first"),
        F.col("term").alias("hi"),
        F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("lo"),
    )
    votes = [
        F.sum(F.shiftrightunsigned(half, j).bitwiseAND(F.lit(_LANES))).alias(f"{half}{j}")
        for half in ("hi", "lo")
        for j in range(32)
    ]
    summed = dealt.groupBy(*keys).agg(
        F.sum("first").alias("copies"), F.count("hi").alias("total"), *votes
    )

    def bits(half: str) -> Column:
        parts = []
        for j in range(32):
            low = F.col(f"{half}{j}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"{half}{j}", 32)
            for at, count in ((j, low), (j + 32, high)):
                value = F.shiftleft(F.lit(1).cast("bigint"), at)
                parts.append(F.when(count * 2 > F.col("total"), value).otherwise(F.lit(0).cast("bigint")))
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return summed.select(*keys, "copies", bits("hi").alias("hi"), bits("lo").alias("lo"))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(hi, lo, hi2, lo2) / F.lit(float(BITS))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, version, text with next_id, next_version, next_text by ascending doc_id.

    After the last document comes the first. Documents go to ranges of ids, one per
    shuffle partition, with quantiles as bounds; the first document of each range is
    sent to the range before it too, so that no range needs another. Rows with one
    doc_id follow each other in order of their text hash. Without id there is no next.
    """
    spark = docs.sparkSession
    rows = texts_of(docs).select("doc_id", F.xxhash64("text").alias("version"), "text")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(
        F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("bounds"),
        F.min("doc_id").alias("least"),
    ).first()
    least = found["least"]
    bounds = sorted({b for b in found["bounds"] or [] if b > least})
    width = max(1, int(len(bounds) ** 0.5))
    all_bounds = F.lit(bounds).cast("array<bigint>")
    coarse = F.lit(bounds[width - 1 :: width]).cast("array<bigint>")
    # the number of bounds up to the id, looked up in two steps
    blocks = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id")))
    near = F.slice(all_bounds, blocks * width + 1, width)
    place = blocks * width + F.size(F.filter(near, lambda b: b <= F.col("doc_id")))
    rows = rows.withColumn(
        "range",
        F.when(F.col("doc_id").isNull(), -1 - F.pmod("version", F.lit(ranges)).cast("int")).otherwise(place),
    )
    opens = F.get(all_bounds, F.col("range") - 1) == F.col("doc_id")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    before = F.struct((F.col("range") - 1).alias("range"), F.lit(True).alias("tail"))
    wraps = F.struct(F.lit(len(bounds)).alias("range"), F.lit(True).alias("tail"))
    copies = (
        F.when(F.col("doc_id") == F.lit(least).cast("bigint"), F.array(own, wraps))
        .when((F.col("range") > 0) & opens, F.array(own, before))
        .otherwise(F.array(own))
    )
    dealt = rows.select("doc_id", "version", "text", F.explode(copies).alias("to"))
    order = Window.partitionBy("to.range").orderBy("to.tail", "doc_id", "version")
    there = F.col("doc_id").isNotNull()
    led = dealt.select(
        "doc_id",
        "version",
        "text",
        "to",
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("doc_id", "version", "text")],
    )
    return led.filter("not to.tail").select(
        "doc_id",
        "version",
        "text",
        F.when(there, F.col("next_doc_id")).alias("next_id"),
        F.when(there, F.col("next_version")).alias("next_version"),
        F.coalesce(F.when(there, F.col("next_text")), F.lit("")).alias("next_text"),
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likenesses.

    The edited text: the last floor(n_chars / 2) code points give way to the first as
    many (or all) of the next document. One row for each row of docs: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and hi, lo
    (the fingerprint as two integers). Null texts are empty; a text without words has a
    fingerprint without bits; equal texts have equal fingerprints. A null doc_id has no
    next document, its edited text ends with its first half, near_next is null. An
    empty table gives an empty result; further columns are not read.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)
    )
    rows = with_next(docs).select(
        "doc_id", "version", "next_id", "next_version", n.alias("n_chars"), "text", edited.alias("edited")
    )
    keys = ["doc_id", "version", "next_id", "next_version", "n_chars", "edited_sha"]
    rows = rows.withColumn("edited_sha", F.unhex(F.sha2("edited", 256)))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")),
    )
    rows = rows.select(*keys, F.inline(sides))
    prints = durable(fingerprint_rows(rows, [*keys, "side"], "text"))
    pick = {f"{half}{side}": F.max(F.when(F.col("side") == side, F.col(half))) for side in (0, 1) for half in ("hi", "lo")}
    both = prints.groupBy(*keys).agg(
        F.max("copies").alias("copies"), *[v.alias(k) for k, v in pick.items()]
    )
    after = prints.filter("side = 0 and doc_id is not null").groupBy("doc_id", "version").agg(
        F.max("hi").alias("hi2"), F.max("lo").alias("lo2")
    )
    after = after.withColumnsRenamed({"doc_id": "next_id", "version": "next_version"})
    done = both.join(after, ["next_id", "next_version"], "left")
    done = done.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return done.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        text_of("hi0", "lo0").alias("fingerprint"),
        text_of("hi1", "lo1").alias("edited_fingerprint"),
        likeness(F.col("hi0"), F.col("lo0"), F.col("hi1"), F.col("lo1")).alias("near_edited"),
        likeness(F.col("hi0"), F.col("lo0"), F.col("hi2"), F.col("lo2")).alias("near_next"),
        F.col("hi0").alias("hi"),
        F.col("lo0").alias("lo"),
    )


def text_of(hi: str, lo: str) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def _block(i: int, hi: str, lo: str) -> Column:
    half = hi if i < 4 else lo
    return F.shiftrightunsigned(half, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, n_near: for each different fingerprint of queries the number of rows of
    prints (hi, lo) within the Hamming radius. Rows with equal fingerprints are counted
    before they meet, so that copies make no pairs. Null fingerprints match nothing."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the tables find distances up to {RADIUS}")
    choices = list(combinations(range(BLOCKS), 2))

    def tables(df: DataFrame, hi: str, lo: str) -> DataFrame:
        keyed = F.array(
            *[
                F.struct(
                    F.lit((1 << i) + (1 << j)).alias("blocks"),
                    (F.shiftleft(_block(i, hi, lo), 16) + _block(j, hi, lo)).alias("key"),
                )
                for i, j in choices
            ]
        )
        return df.select("*", F.inline(keyed))

    counted = durable(prints.filter("hi is not null").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")))
    asked = durable(
        queries.filter("hi is not null").select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct()
    )
    left, right = tables(counted, "hi", "lo"), tables(asked, "q_hi", "q_lo")
    same = reduce(
        lambda a, b: a + b,
        [
            F.when(_block(i, "hi", "lo") == _block(i, "q_hi", "q_lo"), 1 << i).otherwise(0)
            for i in range(BLOCKS)
        ],
    )
    # the two lowest bits of the blocks that agree
    rest = same.bitwiseAND(same - 1)
    two = same - rest + rest.bitwiseAND(-rest)
    # both sides grow with the documents: a merge join, whatever sizes are estimated
    met = left.join(
        right.hint("merge"),
        (left["blocks"] == right["blocks"])
        & (left["key"] == right["key"])
        & (distance(F.col("hi"), F.col("lo"), F.col("q_hi"), F.col("q_lo")) <= radius)
        & (two == left["blocks"]),
    )
    return met.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_near"))


def edited_pairs_with_neighbours(docs: DataFrame) -> DataFrame:
    """edited_pairs with n_near: for documents whose id is divisible by 20, the number of
    rows of docs (itself among them) within the radius of their fingerprint; else null."""
    pairs = durable(edited_pairs(docs))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = durable(within_radius(pairs.select("hi", "lo"), pairs.filter(asked).select("hi", "lo")))
    joined = pairs.join(near, ["hi", "lo"], "left")
    return joined.select(
        *[c for c in pairs.columns if c not in ("hi", "lo")],
        F.when(asked, F.col("n_near")).alias("n_near"),
    )
