"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has SIZE coordinates. In each of the first SIZE rounds every element of a set
is hashed anew into one coordinate with a value; in round SIZE + i every element goes to
coordinate i. A coordinate keeps the smallest value of the earliest round that reaches
it, and rounds stop when all are filled, so that every coordinate is filled for certain
and the share of equal coordinates estimates the Jaccard similarity with the
concentration of independent samples (Dahlgaard, Knudsen, Thorup 2017).

ROWS coordinates make a band. Documents that agree in a band are candidates: two sets
of similarity 0.8 miss all 32 bands with probability (1 - 0.8**4)**32 = 5e-8. Equal
sets are one class from the start. Candidates are tested on the whole sets (of 64-bit
shingle hashes). A bucket is not expanded into its pairs:

* A class is left out if more than a fifth of its shingles are in no other candidate
  set: then no similarity can reach 0.8. In a group of copies with many edits each this
  leaves those that can have links at all. The bound is exact.
* The others are compared with the bucket's leader, the one with the fewest shingles
  of its own, and form components.
* Only pairs of different components that share a bucket remain. Two sets share at most
  what both share with the leader, and outside the leader what either shares with
  anybody. Pairs that this leaves possible are tested, in the first band they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import (
    durable,
    gram_hashes,
    map_rows,
    mix,
    sorted_join,
    span_hashes,
    texts_of,
    words,
)
from ragassay.llm.components import components

SIZE, ROWS = 128, 4
SHIFT = np.uint64(57)  # the upper 7 bits of a hash choose one of 128 coordinates


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words if there are fewer."""
    _, _, hashes = words(text, lower=True)
    if len(hashes) >= k:
        return np.unique(gram_hashes(hashes, k))
    return span_hashes(hashes, np.array([0]), np.array([len(hashes)]))[: len(hashes)]


def sketch(elements: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a non-empty set of hashes."""
    filled = np.zeros(SIZE, bool)
    values = np.zeros(SIZE, np.uint64)
    done = 0
    while not filled.all():
        # few elements: many rounds in one step
        rounds = np.arange(done, min(2 * SIZE, done + max(1, 2048 // len(elements))))
        done += len(rounds)
        salt = mix(rounds.astype(np.uint64) + np.uint64(1))
        h = mix(elements[None, :] ^ salt[:, None])
        late = rounds >= SIZE
        bins = (h >> SHIFT).astype(np.int64)
        bins[late] = (rounds[late] - SIZE)[:, None]
        at = (np.arange(len(rounds))[:, None] * SIZE + bins).ravel()
        low = np.full(len(rounds) * SIZE, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, at, h.ravel())
        hit = np.zeros(len(rounds) * SIZE, bool)
        hit[at] = True
        hit = hit.reshape(len(rounds), SIZE)
        new = hit.any(axis=0) & ~filled
        first = hit.argmax(axis=0)
        chosen = low.reshape(len(rounds), SIZE)[first, np.arange(SIZE)]
        values[new] = mix(chosen ^ salt[first])[new]
        filled |= new
    return values


def band_keys(values: np.ndarray) -> list[int]:
    at = np.arange(0, SIZE, ROWS)
    return span_hashes(values, at, at + ROWS).view(np.int64).tolist()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), sig (digest of the whole set), bands; no bands if empty."""

    def of_row(doc_id: int | None, text: str) -> Iterator[tuple]:
        elements = shingle_set(text, k)
        if len(elements):
            sig = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
            yield doc_id, len(elements), sig, band_keys(sketch(elements))
        else:
            yield doc_id, 0, None, []

    return map_rows(texts_of(docs), "doc_id bigint, n bigint, sig binary, bands array<bigint>", of_row)


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """sig, elements: the sets themselves."""

    def of_row(doc_id: int | None, text: str) -> Iterator[tuple]:
        elements = shingle_set(text, k)
        sig = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
        yield sig, elements.view(np.int64)

    return map_rows(texts_of(docs), "sig binary, elements array<bigint>", of_row)


def candidate_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """sig, elements of the classes in members, from the documents that stand for them."""
    ids = members.select(F.col("class_id").alias("__id")).distinct()
    wanted = sorted_join(
        docs.select("doc_id", "text"), ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi"
    )
    # rows of one class, or of one doc_id, may come more than once
    return whole_sets(wanted, k).groupBy("sig").agg(F.first("elements").alias("elements"))


def own_shingles(sets: DataFrame) -> DataFrame:
    """sig, own: the number of elements that are in no other of the sets.

    sets is a written table with a number for each row: reads of it need not be split alike.
    """
    once = (
        sets.select("no", F.explode("elements").alias("element"))
        .groupBy("element")
        .agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("no"))
        .filter("n = 1")
    )
    own = once.groupBy("no").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("no", "sig").join(own, "no", "left").select(
        "sig", F.coalesce("own", F.lit(0)).alias("own")
    )


def _compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, both: the size of the intersection of the whole sets of each pair."""
    left = sets.select(F.col("sig").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = F.size("x") + F.size("y")
    return sorted_join(sorted_join(durable(pairs), left, "a"), right, "b").select(
        "a", "b", both.alias("both"), near.alias("total")
    )


def _links(compared: DataFrame, percent: int) -> DataFrame:
    enough = F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent
    return compared.filter(enough).select("a", "b")


def _pair(one: str, two: str) -> list[Column]:
    x, y = F.col(f"{one}sig"), F.col(f"{two}sig")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _with_leader(members: DataFrame) -> DataFrame:
    """Members with the bucket's leader: the one with the fewest shingles of its own."""
    first = F.min_by("sig", F.struct("own", F.xxhash64("sig")))
    chosen = members.groupBy("band", "key").agg(first.alias("lead"))
    return members.join(durable(chosen), ["band", "key"])


def _with_overlap(led: DataFrame, compared: DataFrame) -> DataFrame:
    """Members with `inside`, the shingles they share with the leader, and `outside`,
    those they may share with others beyond it."""
    pairs = led.select("*", F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b"))
    joined = pairs.join(compared.select("a", "b", "both"), ["a", "b"], "left")
    inside = F.coalesce("both", "n")  # no row for the leader itself
    outside = F.col("n") - inside - F.when(F.col("both").isNull(), 0).otherwise(F.col("own"))
    return joined.select(*led.columns, inside.alias("inside"), outside.alias("outside"))


def _all_open(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and may be similar enough."""
    other = members.select(
        "band", "key", F.struct("sig", "n", "label", "inside", "outside", "bands").alias("o")
    )
    shared = F.least("inside", "o.inside") + F.least("outside", "o.outside")
    earlier = F.zip_with(
        F.slice("bands", F.lit(1), F.col("band")),
        F.slice("o.bands", F.lit(1), F.col("band")),
        lambda x, y: x == y,
    )
    met = sorted_join(members, other, ["band", "key"]).filter(
        (F.col("label") < F.col("o.label"))
        & (shared * 100 >= (F.col("n") + F.col("o.n") - shared) * percent)
        & ~F.array_contains(earlier, True)
    )
    return met.select(*_pair("", "o."))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with their labels."""
    labels = labels.select(F.col("node").alias("sig"), F.col("label").alias("__label"))
    known = members.join(labels, "sig", "left").withColumn("label", F.coalesce("__label", "label"))
    spread = known.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    spread = durable(spread.filter("low <> high").select("band", "key"))
    return durable(known.join(spread, ["band", "key"], "left_semi").select(members.columns))


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by Jaccard similarity of at least percent/100.

    Words are runs without ASCII white space after lower-casing A-Z; the set of a
    document are its distinct word shingles, the whole word sequence if it has fewer
    words. One row for each row of docs: doc_id, n_shingles, component_id (smallest
    doc_id reachable), kept (doc_id is that id). Null and empty texts and texts without
    words have n_shingles 0 and stay alone. Rows that repeat a doc_id count as that
    document, all of them are kept or none; a null doc_id gets the component's smallest
    id, or null if it has none. An empty table gives an empty result.
    """
    rows = durable(sketches(docs, shingle))
    classes = durable(
        rows.filter("n > 0").groupBy("sig").agg(
            F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
    )
    members = classes.select("sig", "class_id", "n", F.posexplode("bands").alias("band", "key"))
    # a written table on one side of a join lets Spark split the crowded keys of the other
    crowded = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = durable(sorted_join(members, durable(crowded), ["band", "key"]).drop("size"))
    numbered = candidate_sets(docs, members, shingle).withColumn("no", F.monotonically_increasing_id())
    sets = durable(numbered)
    able = durable(own_shingles(sets))
    members = members.join(able, "sig").filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    led = durable(_with_leader(members.drop("class_id").withColumn("label", F.col("sig"))))
    tests = led.filter("sig <> lead").select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b"))
    compared = durable(_compared(sets, tests.distinct()))
    links = _links(compared, percent)
    still = _open(_with_overlap(led, compared), components(links))
    still = durable(sorted_join(still, classes.select("sig", "bands"), "sig"))
    links = links.union(durable(_links(_compared(sets, _all_open(still, percent)), percent)))
    labels = components(links)
    known = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "class_id", F.coalesce("label", "sig").alias("label")
    )
    lowest = known.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = durable(known.join(lowest, "label").select("sig", "component_id"))
    out = rows.select("doc_id", "n", "sig").join(named, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but the first document of each group.

    Columns are unchanged. Null and empty texts and texts without words are alone and stay;
    rows that repeat a doc_id stay or go together; of equal texts the smallest doc_id stays,
    a null doc_id only if its group has no other. An empty table gives an empty result.
    """
    kept = near_groups(docs).filter("kept").select(F.col("doc_id").alias("__doc_id")).distinct()
    return sorted_join(docs, kept, docs["doc_id"].eqNullSafe(kept["__doc_id"]), "left_semi")
