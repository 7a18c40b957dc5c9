"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: of a text's word shingles (A-Z lower-cased, repeats included), the
bitwise majority of their XXH64 hashes (seed 42): a bit is 1 if set in over half.

Links: two fingerprints within `radius` differing bits.  Every bit position gets
a vector of radius + 1 binary digits; each non-zero vector v makes a table whose
mask keeps the positions whose vector has an odd product with v.  Of two
fingerprints that differ in at most `radius` positions, some v is orthogonal to
all those positions' vectors, so its mask removes every difference: the pair
collides in that table, without exception.

No pair list: equal fingerprints are one class first.  A bucket (fingerprints
alike under one mask) is searched by growing sets: an unvisited fingerprint draws
in all within the radius, those draw in theirs, and each is taken out when it is
reached, so a bucket yields a spanning forest of its links, fewer edges than it
has members.  A bucket of more than HOT members is first split by a second set of
masks over the positions left free, which misses no pair for the same reason and
bounds a split bucket by 2 to the number of positions that both masks leave free
(16 to 18 of 64, whatever the size of the input).

Defined results: a text of fewer words than a shingle is one shingle; null text
and a text without words have fingerprint zero and are linked like any other.
component_id is the smallest doc_id reachable, itself included (null ids count
only where there is no other); repeated rows are returned once each; very long texts
are read whole, their shingles counted piece by piece; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import byte_words, cut, kept, only, parts, table, written

WORDS = 4
RADIUS = 4
SEED = 42
#: Members from which a bucket is split before it is searched.
HOT = 2_048
#: Tasks that a group's fingerprints are dealt to.
SALTS = 16


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Of a text in UTF-8."""
    got = byte_words(text)
    if not got:
        return 0
    n = max(1, len(got) - words + 1)
    h, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        b = min(n, a + 65_536)
        some = got[a : b + words - 1]
        joined = map(join, zip(*(some[k : k + b - a] for k in range(words)), strict=True)) if n > 1 or len(got) >= words else [join(got)]
        ones += _ones(np.fromiter((h(x, seed) for x in joined), "<u8", b - a))
    return int(sum(1 << k for k in np.nonzero(2 * ones > n)[0].tolist()))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set: eight 8-bit counters side by side in a word, emptied before they can overflow."""
    out = np.zeros(64, np.int64)
    low = np.uint64(0x0101010101010101)
    for a in range(0, len(hashes), 255):
        some = hashes[a : a + 255]
        for k in range(8):
            packed = np.array([np.sum((some >> np.uint64(k)) & low, dtype=np.uint64)], "<u8")
            out[k::8] += packed.view(np.uint8)
    return out


def masks(radius: int = RADIUS, bits: int = 64, turn: int = 0) -> list[int]:
    """The covering masks: position i has vector 1 + (i * step + turn) mod (2^(radius+1) - 1), all vectors equally often."""
    size = (1 << (radius + 1)) - 1
    step = next(s for s in range(size // 2 + 2 * turn, 10 * size) if np.gcd(s, size) == 1)
    vectors = [1 + (i * step + turn * (i // size + 1)) % size for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, size + 1)]


def second_masks(first: int, radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Covering masks over the positions that `first` leaves free, joined to it."""
    free = [i for i in range(bits) if not first >> i & 1]
    return [first | sum(1 << i for k, i in enumerate(free) if m >> k & 1) for m in masks(radius, len(free))]


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (smaller, larger) of a spanning forest of the links among distinct fingerprints."""
    rest = np.sort(values.astype(np.uint64))
    edges: list[tuple[int, int]] = []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got = rest[near]
                rest = rest[~near]
                edges += [(min(int(x), int(y)), max(int(x), int(y))) for y in got]
                front += list(got)
    return edges


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash (of the text) and fp (the 64 bits as a signed long) of every document; no shuffle."""

    def run(batches):
        kept("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) of fingerprints that connect every linked pair, from a frame of distinct fingerprints (fp)."""
    first = masks(radius)
    n = parts(distinct.sparkSession)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    each = F.array(*[F.lit(signed(m)) for m in first])
    keyed = distinct.select("fp", F.posexplode(each).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    dealt = keyed.repartition(n, "t", "key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = dealt.join(sizes, ["t", "key"])
    cool = shared.where(F.col("m") <= hot).select("t", "key", F.lit(0).alias("u"), "fp")
    finer = F.array(*[F.array(*[F.lit(signed(s)) for s in second_masks(m, radius)]) for m in first])
    warm = shared.where(F.col("m") > hot).select("t", "fp", F.posexplode(finer[F.col("t")]).alias("u", "mask"))
    warm = warm.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), (F.col("u") + 1).alias("u"), "fp")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                values = fps.values.to_numpy(zero_copy_only=False)
                if len(values) > 1:
                    for x, y in forest(values.view(np.uint64), radius):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64), pa.int64()) for v in (a, b)], names=["a", "b"])

    def searched(rows: DataFrame) -> DataFrame:
        return rows.groupBy("t", "u", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps").mapInArrow(run, "a long, b long")

    return searched(cool).unionByName(searched(warm)).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that names the group) and component_id of every document."""
    prints = written(fingerprints(docs, words), "simhash")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), radius, hot))
    named = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", "root"))
    linked = named.where("root is not null")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    # a group may hold a third of all fingerprints: they meet its smallest id in SALTS tasks
    salted = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"]).select("fp", "root", "component_id")
    alone = named.where("root is null").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    return prints.join(found.unionByName(alone), "fp")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates, all columns as they were.

    The row with the smallest doc_id stays (an id before none; of rows with equal
    ids that with the smallest text_hash; of equal rows any one), so rows without
    an id and different texts under one id are each judged by their own group.
    """
    found = near_duplicates(docs, words, radius)
    return rows_that_stay(docs, found.groupBy("root").agg(F.min(id_order()).alias("k")))


def id_order() -> F.Column:
    """By what a group's rows are ordered: doc_id and text_hash, an id before none."""
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")


def rows_that_stay(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs that are the first (k, by id_order) of their groups, each once."""
    keep = first.select(F.col("k.z").alias("__none"), F.coalesce("k.doc_id", F.lit(0)).alias("__id"), F.col("k.text_hash").alias("__text"))
    own = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text": F.xxhash64("text")})
    key = ["__none", "__id", "__text"]  # never null, so the join's partitions serve what follows
    return own.join(keep, key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
